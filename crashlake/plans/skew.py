"""Skewed triage input: one stack key holds 90 % of all crashes.

Derived from `events` (so it grows with the tables): 9 of every 10 events get
the same sanitizer report and frames, the rest keep their own template.  Used
by the bench's skew case and its test; level-B dedup, the member map and the
rank must stay correct and must not gather the hot key into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake.functions import evidence as A
from crashlake.operators import classify as K
from crashlake.operators import dedup as C
from crashlake.session import materialize, release
from crashlake.sources import fixtures as X

HOT_LOG = ("==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x602000000010\n"
           "WRITE of size 4 at 0x602000000010\n"
           "    #0 0x4a1111 in parse_hot /src/hot.c:42\n"
           "    #1 0x4a2222 in main /src/main.c:7")


def skewed_logs(spark: SparkSession, sf: str) -> DataFrame:
    log = X.view(spark, sf, "v_log")
    raw = F.when(F.col("ord") % 10 != 0, F.lit(HOT_LOG)).otherwise(F.col("raw"))
    return log.select("ord", "signal", raw.alias("raw"))


def skewed_level_b(spark: SparkSession, sf: str) -> DataFrame:
    logs = skewed_logs(spark, sf)
    issues = logs.select("ord", "signal", F.lit(1).cast("bigint").alias("duplicate_count"))
    dbg = logs.select("ord", A.parse_log(F.col("raw")).alias("dbg"))
    release(spark)
    cl = materialize(C.stack_key(K.classify_full(issues, dbg).drop("evidence")), "classified")
    return C.dedup_stack(cl)
