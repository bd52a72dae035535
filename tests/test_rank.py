"""Severity levels, ordering, sections, recommendations, roll-ups, sink."""

from pyspark.sql import functions as F

from crashlake.operators import rank as FR
from crashlake.operators import rollup as G
from crashlake.operators.sink import write_triage_tables


def _issues(spark, rows):
    return spark.createDataFrame(rows, "ord long, top_cwe string, signal_class string, duplicate_count long")


def test_levels(spark):
    df = FR.prioritize(_issues(spark, [(1, "CWE-787", "ERROR_UNKNOWN", 1), (2, "CWE-476", "ERROR_UNKNOWN", 1),
                                       (3, "unknown", "ERROR_SEGFAULT", 1), (4, "unknown", "ERROR_TIMEOUT", 1),
                                       (5, "CWE-999", "ERROR_UNKNOWN", 1)]))
    lv = {r.ord: r.severity_level for r in df.collect()}
    assert lv == {1: "CRITICAL", 2: "MEDIUM", 3: "HIGH", 4: "LOW", 5: "MEDIUM"}


def test_sort_order_is_stable(spark):
    df = FR.prioritize(_issues(spark, [(1, "unknown", "ERROR_TIMEOUT", 1), (2, "CWE-476", "ERROR_UNKNOWN", 1),
                                       (3, "CWE-787", "ERROR_UNKNOWN", 1), (4, "CWE-125", "ERROR_UNKNOWN", 10),
                                       (5, "CWE-125", "ERROR_UNKNOWN", 1), (6, "CWE-125", "ERROR_UNKNOWN", 1)]))
    ranked = FR.sorted_index(df, FR.priority_order(["ord"]), out_col="issue_rank")
    order = [r.ord for r in ranked.orderBy("issue_rank").collect()]
    assert order == [3, 4, 5, 6, 2, 1]
    assert sorted(r.issue_rank for r in ranked.collect()) == [1, 2, 3, 4, 5, 6]


def test_sections_and_recommendation(spark):
    rows = [(1, "unknown", "ERROR_SEGFAULT", 1, "foo", "x.c:3", ["#0 0x1 in foo (a=1) at x.c:3"]),
            (2, "unknown", "ERROR_FPE", 1, None, None, ["#0 0x1 in __GI_raise (s=1)", "#1 0x2 in bar (a=1) at y.c:9"]),
            (3, "unknown", "ERROR_WHATEVER", 1, None, None, []),
            (4, "CWE-121", "ERROR_ABORT", 1, None, None, [])]
    df = spark.createDataFrame(rows, "ord long, top_cwe string, signal_class string, duplicate_count long, "
                                     "crash_function string, crash_location string, backtrace array<string>")
    rec = {r.ord: r.recommendation for r in FR.recommendation(df).collect()}
    assert rec[1].startswith("Function foo (x.c:3): check pointers")
    assert rec[2].startswith("Function bar (y.c:9): check division")
    assert rec[3] == "Build the target with debug info (-g) and repeat the analysis."
    ranked = FR.sorted_index(FR.prioritize(df), FR.priority_order(["ord"]), out_col="issue_rank")
    sec = {r.ord: (r.section, r.section_rank) for r in FR.section_rank(ranked).collect()}
    assert sec[4] == ("cwe", 1)
    assert sorted(v[1] for k, v in sec.items() if v[0] == "error") == [1, 2, 3]


def test_plot_series(spark):
    pts = spark.createDataFrame([("a", i, 1700000000 + 60 * i, i // 3) for i in range(45)],
                                "fuzzer_instance string, line_no long, unix_time long, unique_crashes long")
    ext = G.plot_extent(pts).collect()[0]
    assert (ext.x_range, ext.y_max, ext.n_points) == (44 * 60, 14, 45)
    ds = G.plot_downsample(pts).orderBy("idx").collect()
    assert [r.idx for r in ds] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 40, 42, 44]
    assert ds[-1].is_last


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "CWE-125", "HIGH")], "ord long, top_cwe string, severity_level string")
    df = df.withColumn("cwe_distribution", F.array(F.struct(F.lit("CWE-125").alias("cwe"), F.lit(1.0).alias("w"))))
    members = spark.createDataFrame([(1, 1, "/p")], "issue_ord long, ord long, path string")
    write_triage_tables(str(tmp_path / "out"), df, members)
    back = spark.read.parquet(str(tmp_path / "out" / "issues")).collect()
    assert back[0].severity_level == "HIGH"
    assert spark.read.parquet(str(tmp_path / "out" / "cwe_long")).count() == 1
