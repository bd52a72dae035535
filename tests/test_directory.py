"""run_triage over a fuzzer output tree, with and without replay logs."""

from pyspark.sql import functions as F

from conftest import PLOT
from crashlake.plans.directory import run_triage
from crashlake.sources import ingest as I


def test_static_run(spark, campaign, tmp_path):
    res = run_triage(spark, str(campaign), out_dir=str(tmp_path / "out"))
    tot = res.rollups["report_totals"].collect()[0]
    assert (tot.raw_crashes, tot.unique_issues) == (6, 4)
    assert res.members.count() == 6
    assert {(s.fuzzer_instance, s.execs_done) for s in res.stats.collect()} == {("gifdec", 987001), ("gifdec 2", 40)}
    pts = res.plot.orderBy("line_no").collect()
    assert [p.unique_crashes for p in pts] == [n for _, n in PLOT]
    assert spark.read.parquet(str(tmp_path / "out" / "issues")).count() == 4


def test_replay_run_merges_by_stack(spark, campaign):
    log = ("==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x60\nWRITE of size 4 at 0x60\n"
           "    #0 0x4a1 in parse_hdr /src/p.c:12\n    #1 0x4a2 in main /src/m.c:3")
    path = {r.name: r.path for r in I.scan_crash_files(spark, str(campaign)).collect()}
    rows = [(path["id_000001,sig_06,time_410,op_splice"], 1, log, ""),
            (path["id_000000,sig_08,time_77,op_int16"], 1, log, ""),
            (path["id_000002,sig_07,time_640,op_quick"], 1, "No stack.", "")]
    logs = spark.createDataFrame(rows, "path string, attempt int, stdout string, stderr string")
    res = run_triage(spark, str(campaign), replay_logs=logs)
    issues = {r.signal: r for r in res.issues.collect()}
    # the abort and the division share stack and CWE -> one issue; the other two contents keep their own
    assert set(issues) == {11, 6, 7}
    assert issues[6].top_cwe == "CWE-122" and issues[6].duplicate_count == 2
    assert issues[6].exploitability == "EXPLOITABLE" and issues[6].issue_rank == 1
    assert issues[11].duplicate_count == 3
    members = res.members.where(F.col("issue_ord") == F.struct(F.lit("gifdec"), F.lit(issues[6].name)))
    assert members.count() == 2
