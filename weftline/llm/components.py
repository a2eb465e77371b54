"""Connected components by alternating large-star and small-star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): every node of `edges` (a, b) with the smallest node it can reach.

    A node's neighbours are never gathered, only their minimum is; so a hub of any degree is one more
    sum. Minima are written before edges meet them, so both sides of that join are plain shuffles, which
    Spark splits where a hub's edges fill one. The number of rounds grows with the logarithm of the longest path."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = table(pairs, name)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = table(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = table(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = table(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
        drop(pairs, low, large, least)
        pairs = after
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
