"""Connected components of a graph of links, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlake.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b): the smallest id that it reaches.  `discard` deletes what it is read from.

    Alternates large-star and small-star steps until the edges are stars.  Each
    step is a minimum per node, combined before the shuffle, and a join that may
    split a hot node's edges; the edges never leave the cluster.
    """
    own = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own, before = stored(own, "edges"), None
    while True:
        state = own.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            out = own.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                own.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
            out._stored_at = own._stored_at
            return out
        before = state
        both = own.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(own.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, own = own, stored(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(last, large)
