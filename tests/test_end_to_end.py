"""Static (no replay) triage of a crash tree, end to end."""

from pyspark.sql import functions as F

from crashlake.operators import classify as K
from crashlake.operators import dedup as C
from crashlake.operators import rank as FR
from crashlake.operators import rollup as G
from crashlake.sources import ingest as I


def test_static_triage(spark, campaign):
    raw = I.scan_crash_files(spark, str(campaign), with_content=True)
    a = C.dedup_exact(raw.select("input_sha1", "ord", "name", "path", "signal", "size"))
    cl = K.classify_static(a).withColumn("backtrace", F.array().cast("array<string>"))
    b = C.dedup_stack(cl)                       # no backtraces: every issue passes through
    issues = FR.prioritize(b)
    ranked = FR.sorted_index(issues, FR.priority_order(["untouched_b", "ord"]), out_col="issue_rank")
    tot = G.report_totals(raw, issues).collect()[0]
    assert (tot.raw_crashes, tot.unique_issues) == (6, 4)
    rows = {r.signal: r for r in ranked.collect()}
    assert rows[6].top_cwe == "CWE-416" and rows[6].severity_level == "CRITICAL" and rows[6].issue_rank == 1
    assert rows[11].top_cwe == "CWE-125" and rows[11].duplicate_count == 3
    assert rows[8].top_cwe == "CWE-369" and rows[7].top_cwe == "unknown"
    assert sorted(r.issue_rank for r in rows.values()) == [1, 2, 3, 4]
