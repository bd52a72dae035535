"""A Bloom filter (of one hash) as a plan: keys that can't occur are ruled out before a join.

The filter is one array of `BITS` bits, set by a hash aggregation of words and
held by a scalar subquery, so it runs when the query runs and its size is fixed.
With more keys than it is made for it lets more rows pass, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two megabytes: of a million keys' complement, one in seventeen gets past it.
BITS = 1 << 24


def _place(key: Column) -> Column:
    """Bit number of a key; one hash, so a test reads the array once."""
    return F.xxhash64(key).bitwiseAND(F.lit(BITS - 1))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))


def key_bits(keys: DataFrame, key: str) -> Column:
    """Array of words of the filter of `key`; a scalar subquery."""
    spark = keys.sparkSession
    one = keys.select(_place(F.col(key)).alias("p"))
    words = one.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("v"))
    every = words.unionByName(spark.range(BITS >> 6).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v")))
    dense = every.groupBy("w").agg(F.bit_or("v").alias("v"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("b")).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """Whether `key` may be among the keys of the filter `bits` (a column made of `key_bits`); a NULL key isn't."""
    place = _place(key)
    return key.isNotNull() & (F.get(bits, F.shiftright(place, 6).cast("int")).bitwiseAND(_bit(place)) != 0)


def where_key_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` may be among those of `keys`; rows with a NULL key can't."""
    bits = key_bits(keys.select(key).where(F.col(key).isNotNull()), key)
    return df.withColumn("_bits", bits).where(may_hold(F.col("_bits"), F.col(key))).select(df.columns)
