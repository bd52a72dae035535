"""Order-dependent numbering and skew-safe joins, as plans without a single-task window.

A window with `orderBy` and no `partitionBy` moves every row into one task.
Here the order is cut into pieces instead: by explicit split points of the sort
key (`numbered`), so a row's piece is a function of its key alone, or by blocks
of an integer position (`running_sum`).  Positions within a piece come from a
window over the piece, its offset from the totals of the pieces before it: a
bounded array, held by a scalar subquery.  Nothing runs while a plan is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegralType

DEFAULT_BLOCK = 1 << 16
#: Blocks whose totals are summed by one window partition.
BLOCKS = 1 << 12
#: Most pieces that an order is cut into, and sampled keys for each.
PIECES = 1024
SAMPLED = 8


def scalar_row(one_row: DataFrame) -> Column:
    """A one-row aggregate as a struct column for use in another plan (a scalar subquery)."""
    return one_row.select(F.struct("*").alias("_row")).scalar()


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row; it runs as a subquery, so there is no join."""
    held = df.withColumn("_row", scalar_row(one_row))
    return held.select(*df.columns, *(F.col("_row")[c].alias(c) for c in one_row.columns))


def ascending(df: DataFrame, order: list[Column]) -> list[Column]:
    """Sort expressions whose ascending order, nulls first, is `order`.

    A descending entry is a column of integers or other numbers, `col.desc()`, its nulls last.
    """
    out = []
    for c in order:
        m = re.fullmatch(r"Column<'(\w+) (ASC NULLS FIRST|DESC NULLS LAST)'>", repr(c))
        if m is None:
            out.append(c)
            continue
        own = F.col(m[1])
        if m[2].startswith("DESC"):
            falling = F.bitwise_not(own) if isinstance(df.schema[m[1]].dataType, IntegralType) else -own
            own = F.struct(own.isNull().alias("none"), falling.alias("v"))
        out.append(own)
    return out


def _pieces(df: DataFrame) -> int:
    """Split points to sample for: a power of two, four pieces a shuffle partition."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(PIECES, 1 << max(1, n - 1).bit_length())


def split_points(keys: DataFrame, key: str, pieces: int) -> Column:
    """Ascending array of at most about `pieces` values of `key`, near its quantiles; a scalar subquery.

    The sample is one value of each of `SAMPLED` * `pieces` strata of the key's
    hash, the one of least hash, found by a hash aggregation of two numbers and
    fetched by a broadcast of as many.  It depends on the values alone, so every
    plan that asks for it gets the same.
    """
    strata = SAMPLED * pieces
    hashed = keys.select(F.col(key).alias("_k"), F.xxhash64(key).alias("_h"))
    least = hashed.groupBy(F.pmod("_h", F.lit(strata)).alias("_s")).agg(F.min("_h").alias("_h")).select("_h")
    found = hashed.join(F.broadcast(least), "_h", "left_semi").distinct()
    every = F.sort_array(F.collect_list("_k"))
    return found.agg(every.alias("_a")).select(F.filter("_a", lambda _, i: (i + 1) % SAMPLED == 0)).scalar()


def in_pieces(df: DataFrame, key: str, splits: Column, most: int, out: str = "_piece") -> DataFrame:
    """`df` with the number of split points at or below `key`: a binary search, unrolled so it stays in generated code."""
    held = df.withColumns({"_splits": splits, out: F.lit(0)})
    step = 1 << most.bit_length()
    while step := step >> 1:
        at = F.col(out)
        go = (at + step <= F.size("_splits")) & (F.get("_splits", at + (step - 1)) <= F.col(key))
        held = held.withColumn(out, F.when(go, at + step).otherwise(at))
    # out of a generator, so that neither filters on the result nor its lineage are traced through the search, which multiplies it
    kept = [c for c in held.columns if c not in ("_splits", out)]
    return held.select(*kept, F.explode(F.array(F.col(out))).alias(out))


def _totals_before(counts: DataFrame, piece: str, n: str, most: int) -> Column:
    """Array by piece (0 to `most`) of the sums of `n` over the pieces before it; a scalar subquery over at most `most` + 1 rows."""
    pairs = F.collect_list(F.struct(F.col(piece).alias("p"), F.col(n).alias("n"))).alias("_a")
    before = lambda p: F.aggregate(F.filter("_a", lambda x: x["p"] < p), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return counts.agg(pairs).select(F.transform(F.sequence(F.lit(0), F.lit(most)), before)).scalar()


def numbered(df: DataFrame, order: list[Column], out_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """0-based position of each row in `order` (within `group_cols`); rows equal in `order` share no place but in any order.

    Rows go through one exchange, by the piece of their key; the counts of the
    pieces are aggregated before theirs.  `df` is read again for the split
    points and the counts, so hold it if it is costly.
    """
    groups = group_cols or []
    pieces = _pieces(df)
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(ascending(df, order))]))
    placed = in_pieces(keyed, "_key", split_points(keyed, "_key", pieces), pieces)
    counts = placed.groupBy("_piece", *groups).agg(F.count(F.lit(1)).alias("_n"))
    local = F.row_number().over(Window.partitionBy("_piece", *groups).orderBy("_key")) - 1
    if not groups:
        before = _totals_before(counts, "_piece", "_n", pieces)
        held = placed.withColumn("_local", local).withColumn("_before", before)
        return held.select(*df.columns, (F.get("_before", F.col("_piece")) + F.col("_local")).alias(out_col))
    # a group has a row per piece at most
    earlier = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_piece").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_piece") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (placed.withColumn("_local", local).join(offsets, on)
            .select(*df.columns, (F.col("_before") + F.col("_local")).alias(out_col)))


def running_sum(df: DataFrame, order_col: str, value_col: str, out_col: str,
                block: int = DEFAULT_BLOCK) -> DataFrame:
    """Inclusive running sum of `value_col` in the order of the integer `order_col`.

    Totals of blocks of `block` positions are summed within runs of `BLOCKS`
    blocks, and the totals of the runs before by a subquery over one row a run.
    """
    b = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block)))
    totals = b.groupBy("_blk").agg(F.sum(value_col).alias("_n")).withColumn("_run", F.floor(F.col("_blk") / BLOCKS))
    runs = totals.groupBy("_run").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("_run").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    pairs = runs.agg(F.collect_list(F.struct(F.col("_run").alias("r"), F.col("_n").alias("n"))).alias("_a")).scalar()
    offsets = totals.select("_blk", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_in")).withColumn("_runs", pairs)
    before = F.aggregate(F.filter("_runs", lambda x: x["r"] < F.col("_run")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    offsets = offsets.select("_blk", (F.col("_in") + before).alias("_before"))
    w = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (b.withColumn("_upto", F.sum(value_col).over(w)).join(offsets, "_blk")
             .select(*df.columns, (F.col("_before") + F.col("_upto")).alias(out_col)))


def global_index(df: DataFrame, order_cols: list[str], pos_col: str, out_col: str) -> DataFrame:
    """0-based dense index over the order (`order_cols`..., `pos_col`)."""
    return numbered(df, [F.col(c) for c in (*order_cols, pos_col)], out_col)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], unique: str, size: str) -> DataFrame:
    """Left join of `left` to one row per key of `right`, hot keys split on both sides.

    `size` (a column of `right`, dropped) is the number of rows of `left` with
    that key, `unique` a column that tells the rows of `left` apart.  A key with
    more rows than a quarter of an even partition's is hot; there are at most
    four times as many such keys as partitions, so they are broadcast.  Hot rows
    are dealt over salts, and the right row of their key is repeated for each.
    Counts are exact, so both sides agree on the salts in any run.
    """
    pieces = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = right.agg(F.sum(size).alias("_every")).scalar()
    sized = right.withColumn("_all", every)
    sized = sized.withColumn("_salts", F.greatest(F.ceil(F.col(size) * pieces / F.col("_all")), F.lit(1)).cast("int")).drop("_all", size)
    hot = sized.where(F.col("_salts") > 1).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("_salts").alias("_of"))
    on = None
    for k in keys:
        c = F.col(k) == F.col(f"_hot_{k}")
        on = c if on is None else on & c
    dealt = left.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(unique), F.coalesce("_of", F.lit(1))).cast("int"))
    dealt = dealt.drop("_of", *[f"_hot_{k}" for k in keys])
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left_join_nonnull(dealt, copies, [*keys, "_salt"], null_keys=keys).drop("_salt")


def left_join_nonnull(left: DataFrame, right: DataFrame, keys: list[str], null_keys: list[str] | None = None) -> DataFrame:
    """Left join that doesn't gather the rows whose join key is NULL.

    A NULL key cannot match, yet a hash exchange would still send every such row
    to the one partition NULL hashes to.  Those rows get a key of their own from
    a hash of the row instead, which no row on the right has, so `left` is read once.
    """
    missing = None
    for k in null_keys or keys:
        c = F.col(k).isNull()
        missing = c if missing is None else (missing | c)
    plain = [f.name for f in left.schema.fields if isinstance(f.dataType, AtomicType)]
    inner = left.withColumn("_spread", F.when(missing, F.xxhash64(*plain)))  # NULL where the key is whole
    other = right.select(*[F.col(c).alias(f"_right_{c}") for c in right.columns], F.lit(None).cast("long").alias("_none"))
    on = F.col("_spread").eqNullSafe(F.col("_none"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return inner.join(other, on, "left").select(*left.columns, *[F.col(f"_right_{c}").alias(c) for c in right.columns if c not in keys])
