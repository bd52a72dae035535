"""A value that several parts of an expression need is computed once per row: each costly part stands in a plan once."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from crashlake.functions import cwe as D
from crashlake.functions import evidence as A
from crashlake.functions.patterns import hex_to_decimal, once
from crashlake.operators import classify as K
from crashlake.plans.catalog import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,part,times", [
    ("sanitizer_rules", r"negation of \S+ cannot", 1),
    ("apply_oob_direction", r"negation of \S+ cannot", 1),
    ("merge_evidence", r"(READ|WRITE)\s+of\s+size", 1),
    ("normalize_distribution", "aggregate(", 1),
    ("cwe_long", "aggregate(", 1),
    ("top_cwe", "aggregate(", 2),  # the sum and the arg-max
    ("exploit_score", "aggregate(", 2),
    ("parse_replay_log", r"si_addr\s", 1),
])
def test_costly_parts_stand_in_the_plan_once(spark, name, part, times):
    assert optimized(QUERIES[name](spark, SF_SMALL)).count(part) == times


def test_user_frame_is_searched_once(spark):
    df = spark.createDataFrame([(1, ["#0  0x1 in f (a=1) at x.c:1"], (None, None))], "ord long, backtrace array<string>, san_loc struct<func:string,loc:string>")
    found = K.locate(df)
    assert optimized(found).count("/sysdeps/") == 1
    assert [(r.crash_function, r.crash_location) for r in found.collect()] == [("f", "x.c:1")]


def test_words_that_admit_a_regex_drop_no_match(spark):
    """Upper and lower case, a missing word, an empty and a NULL text."""
    texts = ["SI_ADDR = 0xFF\nRIP 0x00aB\n=> 0x1 <f+2>:\t  idiv ecx ", "eip 0x10 si_addr=0x0", "pc 0x5", "#1 x\n #2 y", "#1", "No stack.", "No stack.\n#0 f", "No stack. ERROR: x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(2)
    rows = {r.i: r.d for r in df.select("i", A.parse_log(F.col("raw")).alias("d")).collect()}
    got = [d and (d.backtrace, d.faulting_instruction, None if d.faulting_address is None else int(d.faulting_address), None if d.pc is None else int(d.pc)) for d in map(rows.get, range(len(texts)))]
    assert got == [([], "idiv ecx", 255, 171), ([], None, 0, 16), ([], None, None, 5), (["#1 x", "#2 y"], None, None, None), ([], None, None, None),
                   None, (["#0 f"], None, None, None), ([], None, None, None), ([], None, None, None), None]


def test_once_keeps_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, "0x1f"), (3, "0x" + "f" * 17), (4, "0x000")], "i int, h string").repartition(2)
    out = df.select("i", hex_to_decimal(F.col("h")).alias("d"), once(F.col("h"), lambda x: F.coalesce(x, F.lit("none"))).alias("n"))
    assert dict(out.dtypes)["d"] == "decimal(20,0)"
    got = sorted((r.i, r.d and int(r.d), r.n) for r in out.collect())
    assert [x[:2] for x in got] == [(1, None), (2, 31), (3, 99999999999999999999), (4, 0)] and got[0][2] == "none"
    empty = spark.createDataFrame([(1,)], "i int").select(D.normalize(F.array().cast(D.DIST_TYPE)).alias("d"), D.normalize(F.lit(None).cast(D.DIST_TYPE)).alias("n")).collect()[0]
    assert [tuple(x) for x in empty.d] == [("unknown", 1.0)] and empty.n is None
