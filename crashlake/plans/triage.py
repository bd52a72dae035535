"""End-to-end triage plans over the fixture views (the shapes a user runs)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake.functions import evidence as A
from crashlake.operators import classify as K
from crashlake.operators import dedup as C
from crashlake.operators import rank as FR
from crashlake.sources import fixtures as X
from crashlake.sources import ingest as I
from crashlake.session import materialize, release

SOURCE_ROOTS = ["/src"]


def raw_crashes(spark: SparkSession, sf: str) -> DataFrame:
    """Crash inputs: one row per file, path under its instance's `crashes/`."""
    raw = X.view(spark, sf, "v_raw")
    return raw.select(
        "ord", "name", "fuzzer_instance", "input_sha1", "size",
        F.concat(F.lit("/out/"), F.col("fuzzer_instance"), F.lit("/crashes/"), F.col("name")).alias("path"),
        I.signal_from_name(F.col("name")).alias("signal"))


def log_crashes(spark: SparkSession, sf: str) -> DataFrame:
    """One crash per replay log (`v_log`), with its parsed debugger result."""
    return X.view(spark, sf, "v_log").select("ord", "signal", "raw", A.parse_log(F.col("raw")).alias("dbg"))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return X.view(spark, sf, "v_symbols")


def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.view(spark, sf, "v_source_lines").select("file", "line", "text")


@dataclass
class Triage:
    raw: DataFrame
    level_a: DataFrame       # exact dedup (C1)
    classified: DataFrame    # level A + D22 + stack_hash, in files
    level_b: DataFrame       # C2
    level_c: DataFrame       # C3
    issues: DataFrame        # level C + severity (E6)


def triage(spark: SparkSession, sf: str, with_debug_info: bool = True) -> Triage:
    """A -> E1 join replay facts -> D22 -> C2 -> C3 -> E6.

    Cheap exact dedup decides which logs are parsed at all; facts are taken from
    a log before it is moved.  The classified level-A table feeds level B, the
    member map and the report, several times each, so it is written once, while
    the plan is built; all after it reads the columns it needs from the files
    and moves slim rows only.
    """
    release(spark)
    raw = raw_crashes(spark, sf)
    level_a = C.dedup_exact(raw.select("input_sha1", "ord", "name", "fuzzer_instance", "size", "path", "signal"))
    first = raw.groupBy("input_sha1").agg(F.min("ord").alias("ord"))
    logs = I.replay_facts(X.view(spark, sf, "v_replay"), only=first)
    sym = symbols(spark, sf) if with_debug_info else None
    src = source_lines(spark, sf) if with_debug_info else None
    classified = K.classify_full(level_a, logs, sym, src, SOURCE_ROOTS)
    classified = materialize(C.stack_key(classified.drop("evidence")), "classified")
    level_b = C.dedup_stack(classified)
    level_c = C.dedup_location(level_b)
    issues = FR.prioritize(level_c)
    return Triage(raw, level_a, classified, level_b, level_c, issues)


def ranked_issues(t: Triage) -> DataFrame:
    """issues with their 1-based report position."""
    return FR.sorted_index(t.issues, issue_order(), out_col="issue_rank")


def issue_order() -> list[Column]:
    return FR.priority_order(["untouched_c", "untouched_b", "ord"])
