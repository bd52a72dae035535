"""Three-level crash dedup.

Every level is one aggregation of the order key alone (partial + final, so a
key holding a third of all crashes is pre-combined map-side): the first member
in crash order, the summed duplicate count and the number of merged issues.
With a fixed-width order key (an integer `ord`) it is a hash aggregation.  The
representative's columns are fetched afterwards by a join on its order key,
which is unique, so no hot key and no wide row meets in the aggregation.
Member lists are never collected: they stay in the long-form member table,
whose rows are mapped to the final issue by joins (C5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlake.functions import frames as B
from crashlake.operators.sequence import salted_join, scalar_row


def dedup_exact(raw: DataFrame) -> DataFrame:
    """C1, level A: one issue per `input_sha1`; the first crash in order represents it.

    Input: crash rows with `input_sha1` and `ord` (any orderable type, unique).
    Output: representative columns + `duplicate_count` (crashes in the group).
    """
    first = raw.groupBy("input_sha1").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("duplicate_count"))
    first = first.select(F.col("_first").alias("ord"), "duplicate_count")
    return raw.join(first, "ord").select("input_sha1", *[c for c in raw.columns if c != "input_sha1"], "duplicate_count")


def _dedup_level(issues: DataFrame, key: list[Column], usable: Column, flag: str, after: str | None = None) -> DataFrame:
    """One issue per key among the `usable` ones, the first by (`after`, `ord`); the others pass, with `flag` set."""
    names = [f"_k{i}" for i in range(len(key))]
    late = F.lit(False) if after is None else F.col(after)
    keyed = issues.where(usable).select("ord", "duplicate_count", late.alias("_late"), *[k.alias(n) for k, n in zip(key, names)])
    first = keyed.groupBy(*names).agg(
        F.min(F.when(~F.col("_late"), F.col("ord"))).alias("_a"), F.min(F.when(F.col("_late"), F.col("ord"))).alias("_b"),
        F.sum("duplicate_count").alias("_dup"), F.count(F.lit(1)).alias("_merged"))
    first = first.select(F.coalesce("_a", "_b").alias("ord"), "_dup", "_merged")
    carry = [c for c in issues.columns if c not in ("duplicate_count", "merged_issues")]
    merged = F.col("_merged").isNotNull()
    return (issues.join(first, "ord", "left").where(merged | ~F.coalesce(usable, F.lit(False)))
            .select(*carry, F.coalesce("_dup", "duplicate_count").alias("duplicate_count"),
                    F.coalesce("_merged", F.lit(1)).cast("bigint").alias("merged_issues"), (~merged).alias(flag)))


def dedup_stack(issues: DataFrame, backtrace_col: str = "backtrace") -> DataFrame:
    """C2, level B: key (stack hash of the top 5 normalized frames, top CWE).

    Issues without a stack hash pass through; in list order they follow the
    merged ones (`untouched_b`).  Output order key: (`untouched_b`, `ord`).
    """
    if "stack_hash" not in issues.columns:
        issues = stack_key(issues, backtrace_col)
    h = F.col("stack_hash")
    return _dedup_level(issues, [h, F.col("top_cwe")], h.isNotNull(), "untouched_b")


def dedup_location(issues: DataFrame) -> DataFrame:
    """C3, level C: key (crash location, faulting instruction or '', top CWE).

    Issues with a NULL or empty location pass through after the merged ones.
    Input carries `untouched_b` (from C2); output order key:
    (`untouched_c`, `untouched_b`, `ord`).
    """
    loc = F.col("crash_location")
    key = [loc, F.coalesce(F.col("faulting_instruction"), F.lit("")), F.col("top_cwe")]
    return _dedup_level(issues, key, loc.isNotNull() & (loc != ""), "untouched_c", after="untouched_b")


def cascade_counts(raw: DataFrame, level_a: DataFrame, level_b: DataFrame, level_c: DataFrame) -> DataFrame:
    """C4: crash and issue counts after each level, one row; the three issue counts are subqueries of the first."""
    out = raw.agg(F.count(F.lit(1)).alias("raw_crashes"))
    for df, name in ((level_a, "level_a_issues"), (level_b, "level_b_issues"), (level_c, "level_c_issues")):
        out = out.withColumn(name, scalar_row(df.agg(F.count(F.lit(1)).alias("n")))["n"])
    return out


def stack_key(issues: DataFrame, backtrace_col: str = "backtrace") -> DataFrame:
    """Level-A issues with their level-B key column `stack_hash`."""
    return issues.withColumn("stack_hash", B.stack_hash(F.col(backtrace_col)))


def issue_members(raw: DataFrame, level_a_keyed: DataFrame, level_b: DataFrame) -> DataFrame:
    """Every crash path with the final (level C) issue it belongs to, long form.

    Issue maps are composed at issue granularity first (level A -> B -> C, joins
    to one row per group), then the crash table is shuffled once, joined on
    `input_sha1`.  Each group's size is known, so groups that hold many rows
    are salted on both sides (`salted_join`).  Member order inside an issue is
    the sort key (`untouched_b`, `b_ord`, `a_ord`, `ord`): the order in which the
    concatenated path lists would list them.  No list is ever collected.
    """
    a = level_a_keyed.select("input_sha1", F.col("ord").alias("a_ord"), "stack_hash", "top_cwe", "duplicate_count")
    b_groups = (a.where(F.col("stack_hash").isNotNull()).groupBy("stack_hash", "top_cwe")
                .agg(F.min("a_ord").alias("b_ord"), F.count(F.lit(1)).alias("_n")))
    a_to_b = (salted_join(a, b_groups, ["stack_hash", "top_cwe"], "a_ord", "_n")
              .select("input_sha1", "a_ord", "duplicate_count",
                      F.coalesce(F.col("b_ord"), F.col("a_ord")).alias("b_ord"),
                      F.col("stack_hash").isNull().alias("untouched_b")))
    loc = F.col("crash_location")
    keys = [loc.alias("_l"), F.coalesce(F.col("faulting_instruction"), F.lit("")).alias("_i"),
            F.col("top_cwe").alias("_c")]
    b = level_b.select(F.col("ord").alias("b_ord"), "untouched_b", "merged_issues", *keys,
                       (loc.isNotNull() & (loc != "")).alias("_usable"))
    c_groups = (b.where("_usable").groupBy("_l", "_i", "_c")
                .agg(F.min(F.when(~F.col("untouched_b"), F.col("b_ord"))).alias("_x"),
                     F.min(F.when(F.col("untouched_b"), F.col("b_ord"))).alias("_y"), F.count(F.lit(1)).alias("_n")))
    b_to_c = (salted_join(b.withColumn("_l", F.when(F.col("_usable"), F.col("_l"))), c_groups, ["_l", "_i", "_c"], "b_ord", "_n")
              .select("b_ord", F.coalesce("_x", "_y", "b_ord").alias("issue_ord"), (~F.col("_usable")).alias("untouched_c"),
                      "merged_issues"))
    sha_to_issue = salted_join(a_to_b, b_to_c, ["b_ord"], "a_ord", "merged_issues")
    crashes = raw.select("input_sha1", "ord", "path")
    return (salted_join(crashes, sha_to_issue, ["input_sha1"], "ord", "duplicate_count")
            .select("issue_ord", "untouched_c", "untouched_b", "b_ord", "a_ord", "ord", "path"))
