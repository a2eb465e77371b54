"""Sharding into contiguous runs of nearly equal bytes.

Rows are put in key order by range partitions. Each partition's bytes and rows are summed, the sums
of the partitions are added up (one row per partition, so that list is as short as the partition
count), and offset plus running sum within the partition is a row's global prefix sum. Shards are
cut at equal targets: a row belongs to the shard in which its middle byte falls.

Defined results: null text has 0 bytes; null ids come first; equal rows are interchangeable and are
kept apart by their input position; an empty table gives an empty table; shards may be empty when
there are fewer rows than shards. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table


def byte_size(text):
    """UTF-8 bytes of a text, 0 for null, plus 1 for the separator."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def numbered(rows: DataFrame, order: list, name: str, size_col: str | None = None) -> DataFrame:
    """`rows` with number, their place from 1 in the order, and with `size_col` its running total (`upto`) and its
    total (`total`). Rows go to range partitions; each partition's sums are added up, one row a partition."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.col(size_col) if size_col else F.lit(0)
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "__at")
    dealt = table(dealt.withColumn("__part", F.spark_partition_id()), name)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(F.sum(size).alias("__size"), F.count(F.lit(1)).alias("__rows"))
    offsets = sums.select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__size_before"),
        F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__rows_before"), F.sum("__size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order, "__at")
    placed = dealt.select("*", F.row_number().over(inside).alias("__row"), F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__sum"))
    joined = placed.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))  # one row per partition
    added = [(F.col("__size_before") + F.col("__sum")).alias("upto"), F.col("total")] if size_col else []
    return joined.select(*[F.col(c) for c in rows.columns], (F.col("__rows_before") + F.col("__row")).alias("number"), *added)


def contiguous_shards(sized: DataFrame, *, order: list[str], size_col: str = "size", shards: int = 16) -> DataFrame:
    """`sized` (narrow rows: keys and sizes, no texts) with shard and slot, its place in the shard.

    `order`: columns that define the sequence."""
    columns = sized.columns
    renamed = sized.toDF(*[f"__own_{c}" for c in columns])
    placed = numbered(renamed, [f"__own_{c}" for c in order], "shard-rows", f"__own_{size_col}")
    placed = placed.withColumn("__twice_middle", 2 * F.col("upto") - F.col(f"__own_{size_col}"))
    placed = placed.withColumn("__shard", F.least(F.lit(shards - 1), F.expr(f"(__twice_middle * {shards}) div (2 * total)")).cast("int"))
    placed = table(placed.select(*[F.col(f"__own_{c}") for c in columns], "__shard", "number"), "shard-places")
    first = placed.groupBy(F.col("__shard").alias("__s")).agg(F.min("number").alias("__first"))
    return placed.join(F.broadcast(first), F.col("__shard") == F.col("__s")).select(  # one row per shard
        *[F.col(f"__own_{c}").alias(c) for c in columns], F.col("__shard").alias("shard"), (F.col("number") - F.col("__first")).cast("long").alias("slot")
    )
