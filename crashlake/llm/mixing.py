"""Mixing sources to target weights by pivotal dependent rounding.

`targets` shares a budget of words among the sources: a source's target is its
weight times one common level, or `max_repeats` times its size if that is less;
the level is the one at which the targets sum to the budget (what sharing the
excess again by weight ends in).  Every document of a source then has the same
expected number of copies, target / size of the source.  Its whole part is
given; the fraction is rounded by the pivotal method: two documents with
fractional parts are paired and a number of words is moved at random from one
to the other, so that one of them becomes integral, no expectation changes and
the words taken from the pair stay as they are.  One document remains with a
fraction and is rounded to the nearest; so the words taken from a source differ
from the target by half the size of one document at most.

The pairs form a reduction tree: documents are dealt by hash to groups of about
`GROUP` within their source (so a hot source has many groups), each group
leaves at most one residual, and residuals meet in groups of `FAN_IN` until one
is left for each source.  Random numbers derive from the seed and the place in
the tree and each group is sorted first, so reruns agree.

Defined cases: a null text or one without words has size 0 and takes 0 words; a
null source is a source of its own, the last; repeated rows are documents of
their own; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlake.llm.common import SPACE_CLASS, stored

GROUP = 8192
FAN_IN = 64
_ROWS = "_src long, _group long, _level int, _residual boolean, _no_id boolean, doc_id long, size long, _key long, _text long, _whole long, _part double, _copies long"


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.col(text), f"[{SPACE_CLASS}]+", -1)
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    ends = empty(F.element_at(parts, 1)) + F.when(F.size(parts) > 1, empty(F.element_at(parts, -1))).otherwise(0)
    return F.coalesce((F.size(parts) - ends).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_repeats: float) -> DataFrame:
    """source, source_size, target, _src of each source; sizes: source, source_size.

    One row per source, ordered by code point with null last; the weights repeat in that order.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("_src", F.row_number().over(order).cast("long"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("_w", F.element_at(cycle, (F.pmod(F.col("_src") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * float(max_repeats))
    # sources reach their caps in the order of cap / weight: at each, what the capped ones hold and the others' weight
    ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_src")
    upto, every = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("_budget", float(budget) * F.sum("source_size").over(every))
    held = F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))
    left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))
    s = s.withColumn("_level", (F.col("_budget") - held) / left)
    s = s.withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
    # the first source that stays below its cap sets the level of all the later ones
    level = F.min(F.when(F.col("_free"), F.col("_level"))).over(every)
    first = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), "_src", "_level"))).over(every)
    level = F.coalesce(first["_level"], level)
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"), "_src")


def pivot(size: np.ndarray, part: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions in (0, 1) to 0 or 1 in pairs; all but one document at most become integral.

    Returns the parts and the place of the document that is left, or -1.
    """
    out = part.copy()
    draws = random.random(len(size)).tolist()
    sizes, parts = size.tolist(), part.tolist()
    i = -1
    for j, p in enumerate(parts):
        if p <= 0.0 or p >= 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b, q = sizes[i], sizes[j], parts[i]
        # words that can go from i to j, and from j to i, until one of them is integral
        there, back = min(q * a, (1.0 - p) * b), min((1.0 - q) * a, p * b)
        if draws[j] * (there + back) < back:
            done_i, done_j, moved = q * a <= (1.0 - p) * b, q * a >= (1.0 - p) * b, there
            parts[i], parts[j] = (0.0 if done_i else q - moved / a), (1.0 if done_j else p + moved / b)
        else:
            done_i, done_j, moved = (1.0 - q) * a <= p * b, (1.0 - q) * a >= p * b, back
            parts[i], parts[j] = (1.0 if done_i else q + moved / a), (0.0 if done_j else p - moved / b)
        if done_i:
            out[i] = parts[i]
            i = j
        if done_j:
            out[j] = parts[j]
            if done_i:
                i = -1
    if i >= 0:
        out[i] = parts[i]
    return out, i


def _round(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Each group's rows with their copies; its residual has none yet, unless it is the last of its source."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_no_id", "doc_id", "size", "_group", "_text", "_key"], ascending=[False, *[True] * 5], kind="stable").reset_index(drop=True)
        src, place = int(group["_src"].iat[0]), int(group["_place"].iat[0])
        random = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed} {level} {src} {place}"))
        part, left = pivot(group["size"].to_numpy(float), group["_part"].to_numpy(float), random)
        if last and left >= 0:
            part[left] = float(part[left] >= 0.5)  # nearest to the target
            left = -1
        group["_part"], group["_level"] = part, level
        group["_residual"] = np.arange(len(group)) == left
        group["_copies"] = group["_whole"] + np.floor(part).astype("int64")
        return group.drop(columns="_place")

    return rows.groupBy("_src", "_place").applyInPandas(reduce, _ROWS)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_repeats: float = 2.0, seed: int = 20240601, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (an integer) of each document.

    key: a column of integers that tells rows apart; it is returned, too.
    """
    row = F.lit(0).cast("long") if key is None else F.col(key).cast("long")
    # rows of equal id and size are dealt and ordered by a hash of the text, so reruns give them the same copies
    text = F.xxhash64("text")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), row.alias("_key"), text.alias("_text")), "mix-sizes")
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_repeats)
    joined = sized.withColumnRenamed("source", "_s").join(per_source, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    n_groups = max(1, -(-sized.count() // GROUP))
    whole = F.when(F.col("size") > 0, F.floor(copies)).otherwise(0).cast("long")
    part = F.when(F.col("size") > 0, copies - F.floor(copies)).otherwise(0.0)
    place = F.pmod(F.xxhash64("doc_id", "size", "_text"), F.lit(n_groups))
    rows = joined.select(
        "_src", place.alias("_group"), F.lit(0).alias("_level"), F.lit(False).alias("_residual"),
        F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "size", "_key", "_text",
        whole.alias("_whole"), part.alias("_part"), whole.alias("_copies"), place.alias("_place"),
    )
    first = stored(_round(rows, seed, 0, n_groups == 1), "mix-level")
    final = first.where(~F.col("_residual"))
    level, left, found = 0, first.where("_residual"), n_groups
    while found > 1:
        level, found = level + 1, -(-found // FAN_IN)
        up = left.withColumn("_group", F.floor(F.col("_group") / FAN_IN) if level > 1 else F.col("_group"))
        up = up.withColumn("_place", F.floor(F.col("_group") / FAN_IN))
        done = stored(_round(up, seed, level, found == 1), "mix-level")
        final = final.unionByName(done.where(~F.col("_residual")))
        left = done.where("_residual")
    sources = per_source.withColumnRenamed("_src", "_n")
    doc_id = F.when(~F.col("_no_id"), F.col("doc_id")).alias("doc_id")  # pandas would make doubles of longs with nulls
    return final.join(sources, F.col("_src") == F.col("_n")).select(
        doc_id, "source", "size", "source_size", "target", F.col("_copies").alias("copies"), *([] if key is None else [F.col("_key").alias(key)])
    )
