"""Shapes of the plans, and the set-based lookups against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from crashlake.operators import dedup as C
from crashlake.operators import lookup as E
from crashlake.operators import rollup as G
from crashlake.operators.bloom import where_key_in
from crashlake.operators.rank import sorted_index
from crashlake.operators.sink import save_classified
from crashlake.operators.sequence import attach_scalar, running_sum, salted_join
from crashlake.plans.catalog import QUERIES
from crashlake.sources import ingest as I


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jobs_of(spark, build):
    """Spark jobs that building a frame starts."""
    group = f"build-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


#: These start from the classified table, which is written while they are built.
TRIAGED = {"dedup_stack", "dedup_location", "dedup_cascade", "duplicate_members", "severity_dim", "label_dims", "prioritize", "issue_rank",
           "section_rank", "split_sections", "recommendation", "concat_passthrough", "count_by_axis", "severity_counts", "report_totals"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRIAGED))
def test_building_a_query_starts_no_job(spark, name):
    QUERIES[name](spark, SF_SMALL).schema  # Parquet footers are read by a job the first time a table is opened
    assert jobs_of(spark, lambda: QUERIES[name](spark, SF_SMALL)) <= footers(name)


def footers(name):
    """Jobs that only read the schemas of input files; views are kept, so there are none the second time."""
    return 1 if name in ("input_sha1", "log_tail") else 0  # these open `documents` anew


def issues(spark, n=200):
    r = random.Random(5)
    rows = [(i, f"h{r.randrange(9)}" if r.random() < 0.8 else None, r.choice(["CWE-122", "CWE-125"]), 1 + i % 3, f"/a.c:{r.randrange(5)}" if r.random() < 0.7 else "",
             r.choice([None, "mov"]), f"wide {i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "ord long, stack_hash string, top_cwe string, duplicate_count long, crash_location string, faulting_instruction string, text string")


def test_dedup_levels_are_hash_aggregations(spark):
    _, df = issues(spark)
    raw = df.select("ord", F.col("stack_hash").alias("input_sha1"), "text")
    for level in (C.dedup_exact(raw), C.dedup_stack(df), C.dedup_location(C.dedup_stack(df))):
        plan = plan_of(level)
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        aggregated = [x for x in plan.splitlines() if "HashAggregate" in x]
        assert not any("text" in x for x in aggregated)


def test_dedup_levels_match_plain_python(spark):
    rows, df = issues(spark)
    level_b, level_c = C.dedup_stack(df), C.dedup_location(C.dedup_stack(df))
    groups = {}
    for o, h, cwe, n, loc, insn, text in rows:
        groups.setdefault((h, cwe) if h else o, []).append((o, n, loc, insn or "", cwe, text))
    b = {g[0][0]: (sum(x[1] for x in g), len(g), not isinstance(k, tuple), g[0][2:]) for k, g in ((k, sorted(g)) for k, g in groups.items())}
    assert {r.ord: (r.duplicate_count, r.merged_issues, r.untouched_b) for r in level_b.collect()} == {o: v[:3] for o, v in b.items()}
    groups = {}
    for o, (n, _, late, (loc, insn, cwe, text)) in b.items():
        groups.setdefault((loc, insn, cwe) if loc else o, []).append((late, o, n, text))
    want = {g[0][1]: (sum(x[2] for x in g), len(g), not isinstance(k, tuple), g[0][3]) for k, g in ((k, sorted(g)) for k, g in groups.items())}
    assert {r.ord: (r.duplicate_count, r.merged_issues, r.untouched_c, r.text) for r in level_c.collect()} == want


def test_members_with_hot_keys(spark):
    """Nine of ten crashes share content, stack and location; every one has its issue, and hot keys are salted."""
    raw_rows = [(i, "same" if i % 10 else f"c{i}", f"/p/{i}") for i in range(2000)]
    raw = spark.createDataFrame(raw_rows, "ord long, input_sha1 string, path string")
    a = C.dedup_exact(raw).withColumn("stack_hash", F.when(F.col("ord") % 3 < 2, F.lit("s"))).withColumn("top_cwe", F.lit("CWE-125"))
    a = a.withColumns({"crash_location": F.lit("/x.c:1"), "faulting_instruction": F.lit(None).cast("string")})
    members = C.issue_members(raw, a, C.dedup_stack(a))
    got = members.collect()
    assert sorted(r.ord for r in got) == list(range(2000)) and all(r.issue_ord is not None for r in got)
    assert {r.issue_ord for r in got} == {r.ord for r in C.dedup_location(C.dedup_stack(a)).collect()}


def test_bucketed_table_is_read_without_a_shuffle_on_its_key(spark, tmp_path):
    _, df = issues(spark)
    df = df.withColumn("severity_level", F.lit("HIGH"))
    saved = save_classified(df, "classified_crashes", str(tmp_path / "t"), 4)
    plan = plan_of(saved.where(F.col("stack_hash").isNotNull()).groupBy("stack_hash", "top_cwe").agg(F.min("ord"), F.sum("duplicate_count")))
    assert "Exchange" not in plan and "Bucketed: true" in plan and "text" not in plan
    assert "hashpartitioning(_k0" not in plan_of(C.dedup_stack(saved))
    counts = plan_of(G.severity_counts(saved))
    assert re.search(r"ReadSchema: struct<severity_level:string>", counts)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, C.dedup_stack(saved).collect())) == sorted(map(key, C.dedup_stack(df).collect()))
    spark.sql("DROP TABLE classified_crashes")


def test_salted_join_splits_hot_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 10 else None if i % 20 else f"k{i}") for i in range(3000)], "id long, k string")
    right = left.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = salted_join(left, right, ["k"], "id", "n")
    got = out.collect()
    assert len(got) == 3000 and out.columns == ["id", "k", "first"]
    assert all(r.first == (1 if r.k == "hot" else r.id if r.k else None) for r in got)


def random_symbols(n, seed):
    r = random.Random(seed)
    out = [(lo, lo + r.choice([0, 3, 40, 500, 1 << 20]), f"f{i % 7}", f"s{i}.c:{i}") for i in range(n) for lo in [r.randrange(1 << 14)]]
    out += [(5, 2, "empty", "e.c:1"), (None, 9, "null", "n.c:1"), (0, (1 << 63) - 1, "corrupt", "c.c:1")] + out[:5]
    return out


def test_symbols_match_a_scan_of_all_ranges(spark):
    symbols = random_symbols(300, 2)
    r = random.Random(3)
    rows = [(i, r.choice([r.randrange(1 << 15), r.randrange(1 << 40), 0, None])) for i in range(1500)]
    got = E.symbolize(spark.createDataFrame(rows, "id int, pc long"), "pc",
                      spark.createDataFrame(symbols, "lo long, hi long, func string, loc string")).collect()
    assert len(got) == len(rows)
    for x in got:
        held = [(hi - lo, lo, f, loc) for lo, hi, f, loc in symbols if None not in (x.pc, lo) and lo <= x.pc <= hi]
        assert (x.sym_func, x.sym_loc) == (min(held)[2:] if held else (None, None))


def test_symbol_plan_reads_the_rows_once(spark):
    rows = spark.range(100).select("id", F.col("id").alias("pc"))
    plan = E.symbolize(rows, "pc", spark.createDataFrame(random_symbols(20, 4), "lo long, hi long, func string, loc string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1


def test_one_wide_symbol_has_few_rows(spark):
    wide = spark.createDataFrame([(0, (1 << 63) - 1, "wide", "w.c:1")], "lo long, hi long, func string, loc string")
    segments, _ = E.symbol_segments(wide)
    assert segments.count() <= 2


def test_key_filter_drops_no_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(9000).select(F.col("id").cast("string").alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    got = {r.id for r in where_key_in(rows, keys, "k").collect()}
    assert set(range(0, 3000, 3)) <= got and -1 not in got and len(got) < 1200


def test_ranks_agree_in_every_run(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("v"))
    ranks = [{r.id: r.rank for r in sorted_index(df.repartition(n), [F.col("v").desc(), F.col("id").asc()]).collect()} for n in (3, 11)]
    assert ranks[0] == ranks[1] and sorted(ranks[0].values()) == list(range(1, 5001))


def test_descending_order_keeps_nulls_last(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(40)], "id long, v int")
    got = {r.id: r.rank for r in sorted_index(df, [F.col("v").desc(), F.col("id").asc()]).collect()}
    want = sorted(range(40), key=lambda i: (i % 4 == 0, 0 if i % 4 == 0 else -(i % 3), i))
    assert [got[i] for i in want] == list(range(1, 41))


def test_numbering_has_no_order_only_window(spark):
    df = spark.range(100).select("id", F.lit(1).alias("v"))
    for out in (sorted_index(df, [F.col("id")]), running_sum(df, "id", "v", "s"), attach_scalar(df, df.agg(F.max("id").alias("m")))):
        plan = plan_of(out)
        for window in re.findall(r"\bWindow \[.*", plan):
            assert not window.rstrip().endswith("[]") and "], [], [" not in window
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_log_text_is_moved(spark):
    logs = spark.createDataFrame([(1, 1, "boom", "")], "ord long, attempt int, stdout string, stderr string")
    plan = plan_of(I.replay_facts(logs, only=spark.createDataFrame([(1,)], "ord long")).drop("evidence"))
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "stdout" not in line and "_text" not in line
