"""Triage of a fuzzer output directory: the library entry a user runs.

    result = run_triage(spark, "hdfs:///fuzz/out", replay_logs=logs, symbols=syms,
                        source_lines=src, roots=["/src"], out_dir="hdfs:///triage/run1")

Inputs besides the directory are tables produced by the external tools:
`replay_logs(path, attempt, stdout, stderr)` (debugger/sanitizer replays),
`symbols(lo, hi, func, loc)` (the target's debug info) and
`source_lines(file, line, text)` (the source tree).  Without replay logs the
crashes are classified from their signal only (the no-replay mode).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.functions import frames as B
from crashlake.functions.evidence import has_result
from crashlake.functions.patterns import PY_LINE_BREAK
from crashlake.operators import classify as K
from crashlake.operators import dedup as C
from crashlake.operators import lookup as E
from crashlake.operators import rank as FR
from crashlake.operators import rollup as G
from crashlake.operators.sink import write_triage_tables
from crashlake.session import materialize
from crashlake.sources import ingest as I


@dataclass
class TriageResult:
    raw: DataFrame            # one row per crash file
    issues: DataFrame         # final issues, ranked (`issue_rank`), with sections, labels and recommendations
    members: DataFrame        # every crash file with its final issue
    stats: DataFrame          # per-instance fuzzer statistics
    plot: DataFrame           # crashes-over-time points in file order
    rollups: dict[str, DataFrame]
    classified: DataFrame     # level A with its classification: what `sink.save_classified` keeps for later reports
    evidence: DataFrame | None = None  # log and stderr tails of the issues' representatives (with replay logs)


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """A5/A6 over the `fuzzer_stats` file of every instance."""
    return I.with_timestamps(I.parse_fuzzer_stats(I.read_instance_files(spark, root, "fuzzer_stats")))


def read_plot(spark: SparkSession, root: str) -> DataFrame:
    """A7 over the `plot_data` file of every instance; `line_no` keeps the file order (one file is one bounded row)."""
    files = I.read_instance_files(spark, root, "plot_data")
    lines = files.select("fuzzer_instance", F.posexplode(F.split("body", PY_LINE_BREAK)).alias("line_no", "line"))
    return I.parse_plot_lines(lines.withColumn("line_no", F.col("line_no").cast("bigint")))


def run_triage(spark: SparkSession, afl_out: str, replay_logs: DataFrame | None = None,
               symbols: DataFrame | None = None, source_lines: DataFrame | None = None,
               roots: list[str] | None = None, out_dir: str | None = None,
               minimized: DataFrame | None = None) -> TriageResult:
    """The whole triage.  The hashed files and the classified crashes are written to the shared folder once, while it is built.

    minimized: `(path, minimized_size)` of crash files that were reduced.
    """
    raw = materialize(I.scan_crash_files(spark, afl_out, with_content=True), "raw")  # hash once; content never shuffled
    level_a = C.dedup_exact(raw.select("input_sha1", "ord", "path", "name", "fuzzer_instance", "signal", "size"))
    if replay_logs is not None:
        logs = I.replay_facts(replay_logs, key="path", only=level_a)
        classified = K.classify_full(level_a, logs, symbols, source_lines, roots, key="path").drop("evidence")
    else:
        classified = (K.classify_static(level_a)
                      .withColumn("backtrace", F.array().cast("array<string>"))
                      .withColumn("crash_location", F.lit(None).cast("string"))
                      .withColumn("crash_function", F.lit(None).cast("string"))
                      .withColumn("faulting_instruction", F.lit(None).cast("string")))
    classified = materialize(C.stack_key(classified), "classified")
    level_b = C.dedup_stack(classified)
    final = FR.prioritize(C.dedup_location(level_b))
    issues = report_issues(final, minimized)
    members = C.issue_members(raw, classified, level_b)
    stats, plot = read_stats(spark, afl_out), read_plot(spark, afl_out)
    rollups = {
        "count_by_axis": G.count_by_axis(issues),
        "severity_counts": G.severity_counts(final),
        "report_totals": G.report_totals(raw, final),
        "cascade_counts": C.cascade_counts(raw, level_a, level_b, final),
        "instance_stats": G.instance_stats(stats),
        "plot_extent": G.plot_extent(plot),
        "plot_normalized": G.plot_normalized(plot),
        "plot_downsample": G.plot_downsample(plot),
    }
    evidence = None if replay_logs is None else issue_evidence(final, replay_logs)
    result = TriageResult(raw, issues, members, stats, plot, rollups, classified, evidence)
    if out_dir is not None:
        more = {} if evidence is None else {"issue_evidence": evidence}
        write_triage_tables(out_dir, issues, members, {**rollups, **more, "fuzzer_stats": stats.drop("raw"), "plot_points": plot})
    return result


def report_issues(final: DataFrame, minimized: DataFrame | None = None) -> DataFrame:
    """Issues as the report lists them: rank, section and rank in it, labels, recommendation (unclassified ones), reduction."""
    order = FR.priority_order(["untouched_c", "untouched_b", "ord"])
    ranked = FR.sorted_index(final, order, out_col="issue_rank")
    ranked = FR.section_rank(ranked, order)
    ranked = ranked.select("*", F.col("taxonomy.crash_site_kind").alias("crash_site_kind"),
                           F.col("taxonomy.memory_region").alias("memory_region"),
                           *([] if "signal_class" in ranked.columns else [F.col("taxonomy.signal_class").alias("signal_class")]))
    ranked = FR.recommendation(E.label_dims(ranked))
    ranked = ranked.withColumn("recommendation", F.when(F.col("section") == "error", F.col("recommendation")))
    sizes = minimized if minimized is not None else final.select("path", F.lit(None).cast("bigint").alias("minimized_size")).limit(0)
    return E.reduction_ratio(ranked, sizes, key="path")


def issue_evidence(final: DataFrame, replay_logs: DataFrame) -> DataFrame:
    """(ord, evidence, stderr_tail) of issues that have a usable log; the tails are cut from the logs of final issues alone."""
    tails = {"evidence": B.log_tail(F.col("_text")), "stderr_tail": B.log_tail(F.coalesce("stderr", F.lit("")), R.STDERR_TAIL_CHARS)}
    found = I.first_usable(replay_logs, {**tails, "has_log": has_result(F.col("_text"))}, key="path", only=final).where("has_log")
    return final.select("ord", "path").join(found, "path").select("ord", *tails)
