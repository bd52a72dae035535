"""Report roll-ups and the crashes-over-time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlake import rules as R
from crashlake.operators.sequence import attach_scalar, global_index

def count_by_axis(ranked: DataFrame) -> DataFrame:
    """G1: issue counts per signal class, crash site, region and verdict in one pass.

    GROUPING SETS aggregate all four axes over one scan (one shuffle); ties in
    count are ordered by first appearance in the ranked list (`first_rank`).
    """
    axes = ["signal_class", "crash_site_kind", "memory_region", "exploitability"]
    g = ranked.groupingSets([[a] for a in axes], *axes).agg(
        F.count(F.lit(1)).alias("n"), F.min("issue_rank").alias("first_rank"),
        *[F.grouping(a).alias(f"_g_{a}") for a in axes])
    axis = None
    for a in axes:
        axis = F.when(F.col(f"_g_{a}") == 0, F.lit(a)) if axis is None else axis.when(F.col(f"_g_{a}") == 0, F.lit(a))
    return g.select(axis.alias("axis"), F.coalesce(*[F.col(a) for a in axes]).alias("value"), "n", "first_rank")


def severity_counts(issues: DataFrame) -> DataFrame:
    """G2."""
    return issues.groupBy("severity_level").agg(F.count(F.lit(1)).alias("n"))


def report_totals(raw: DataFrame, issues: DataFrame) -> DataFrame:
    """Raw crashes, unique issues, critical and high counts (one row)."""
    tot = issues.agg(F.count(F.lit(1)).alias("unique_issues"),
                     F.count_if(F.col("severity_level") == "CRITICAL").alias("critical"),
                     F.count_if(F.col("severity_level") == "HIGH").alias("high"))
    return attach_scalar(raw.agg(F.count(F.lit(1)).alias("raw_crashes")), tot)  # a subquery


def instance_stats(stats: DataFrame) -> DataFrame:
    """Per-instance figures of the statistics table."""
    return stats.select("fuzzer_instance", "execs_done", "execs_per_sec", "paths_total",
                        "unique_crashes", "unique_hangs", "afl_version")


def plot_extent(points: DataFrame) -> DataFrame:
    """Time extent and crash maximum (at least 1), one row."""
    return points.agg(
        F.min("unix_time").alias("x_min"), F.max("unix_time").alias("x_max"),
        F.greatest(F.coalesce(F.max("unique_crashes"), F.lit(0)), F.lit(1)).alias("y_max"),
        F.count(F.lit(1)).alias("n_points"),
    ).withColumn("x_range", F.greatest(F.col("x_max") - F.col("x_min"), F.lit(1)))


def plot_index(points: DataFrame) -> DataFrame:
    """Points in list order (instance, line) with a 0-based index."""
    return global_index(points, ["fuzzer_instance"], "line_no", "idx")


def plot_normalized(points: DataFrame) -> DataFrame:
    """Elapsed seconds and fractions of the time range and crash maximum."""
    ext = plot_extent(points)
    df = attach_scalar(plot_index(points), ext)
    return df.select("idx", "fuzzer_instance", "line_no", "unix_time", "unique_crashes",
                     (F.col("unix_time") - F.col("x_min")).alias("elapsed"),
                     ((F.col("unix_time") - F.col("x_min")) / F.col("x_range")).alias("fx"),
                     (F.col("unique_crashes") / F.col("y_max")).alias("fy"))


def plot_downsample(points: DataFrame) -> DataFrame:
    """Every max(1, n // 20)-th point plus the last one."""
    ext = plot_extent(points).select("n_points")
    df = attach_scalar(plot_index(points), ext)
    step = F.greatest(F.floor(F.col("n_points") / R.PLOT_MAX_DOTS), F.lit(1))
    keep = ((F.col("idx") % step) == 0) | (F.col("idx") == F.col("n_points") - 1)
    return df.where(keep).select("idx", "fuzzer_instance", "line_no", "unix_time", "unique_crashes",
                                 (F.col("idx") == F.col("n_points") - 1).alias("is_last"))
