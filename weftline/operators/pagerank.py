"""PageRank with dead ends and a convergence test.

    r1 = 1 / N;  r(v) = (1 - d) / N + d * sum over u -> v of r(u) / outdeg(u) + d * residual
    residual = sum of r over dead ends / N, of the step before;  stop when sum |r - r before| < tolerance

Parallel edges count, self-loops do not. Dead ends are one scalar a step, never edges to everywhere.
Vertices are numbered once; edges are pairs of numbers, partitioned and sorted by source on the executors, and
names come back with the result. A superstep shuffles the ranks (one row a vertex, with its degree, one exchange
for both joins) and partial sums of contributions; the edges themselves are neither moved nor sorted again. The
edges of hubs (HUB out-edges, or a 65,536th of all edges if that is more) lie by destination instead; the ranks
of these vertices, 65,536 at most, are broadcast, and nothing else is. Ranks are written as
a scratch table after each step, which also adds up the step's two scalars: plans stay as short as the
first, a lost executor costs one step, and the table of the step before goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import InvalidDestination
from ..sources.scratch import drop, sorted_join, table


HUB = 1 << 17


@dataclass(frozen=True)
class Config:
    damping: float = 0.85
    tolerance: float = 0.001

    def __post_init__(self) -> None:
        if not 0 < self.damping <= 1:
            raise ValueError("the damping factor lies above 0 and up to 1")
        if not 0 < self.tolerance < 1:
            raise ValueError("the tolerance lies between 0 and 1")


@dataclass(frozen=True)
class Ranks:
    scores: DataFrame  # id, rank
    superstep: int
    difference: float


def out_degrees(edges: DataFrame) -> DataFrame:
    """(src, degree): parallel edges counted, self-loops not."""
    return edges.where(F.col("src") != F.col("dst")).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def incoming(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, received): the sum of rank over out-degree that each vertex gets along its in-edges."""
    per = ranks.join(sorted_join(out_degrees(edges)), F.col("id") == F.col("src")).select("src", (F.col("rank") / F.col("degree")).alias("share"))
    sent = per.join(sorted_join(edges.where(F.col("src") != F.col("dst"))), "src")
    return sent.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("received"))


def dead_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without an out-edge other than to themselves."""
    return vertices.join(sorted_join(out_degrees(edges)), F.col("id") == F.col("src"), "left_anti")


def pagerank(vertices: DataFrame, edges: DataFrame, *, config: Config = Config(), steps: int | None = None, strict: bool = False) -> Ranks:
    """`vertices`: id. `edges`: src, dst. With `steps`, supersteps 0 to steps - 1 are run whatever the
    difference (the first only counts vertices). Edges from unknown vertices are dropped; to unknown ones
    too, or they raise InvalidDestination when strict."""
    spark = vertices.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = vertices.select("id").distinct()
    if steps is not None and steps <= 1:
        return Ranks(ids.select("id", F.lit(0.0).alias("rank")), max(0, steps), 0.0)
    numbered = table(ids.select("id", F.monotonically_increasing_id().alias("v")), "vertices")
    given = edges.select("src", "dst").where(F.col("src") != F.col("dst")).join(sorted_join(numbered.toDF("known", "s")), F.col("src") == F.col("known"))
    if strict and given.join(sorted_join(numbered), F.col("dst") == F.col("id"), "left_anti").take(1):
        raise InvalidDestination("an edge leads to a vertex that is not there")
    real = table(given.join(sorted_join(numbered.toDF("also", "t")), F.col("dst") == F.col("also")).select("s", "t"), "edges")
    degrees = table(real.groupBy("s").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    total = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    hubs = degrees.where(F.col("degree") >= max(HUB, -(-total // 65_536))).select("s")  # at most 65,536
    some_hubs = bool(hubs.take(1))
    light = real.join(F.broadcast(hubs), "s", "left_anti") if some_hubs else real
    light = light.repartition(parts, "s").sortWithinPartitions("s").persist(StorageLevel.MEMORY_AND_DISK)
    spread = real.join(F.broadcast(hubs), "s", "left_semi").repartition(parts, "t").persist(StorageLevel.MEMORY_AND_DISK) if some_hubs else None
    try:
        base = table(numbered.join(sorted_join(degrees), F.col("v") == F.col("s"), "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree")), "ranks")
        number, dead = base.agg(F.count(F.lit(1)), F.count_if(F.col("degree") == 0)).first()
        if not number:
            return Ranks(ids.select("id", F.lit(0.0).alias("rank")), 0, 0.0)
        d = config.damping
        ranks, written = base.select("v", "degree", F.lit(1.0 / number).alias("rank")), base
        residual, difference, step = dead / number / number, 1.0, 1
        light.count()  # plans trust the order of kept edges only when they are there
        part = (F.col("rank") / F.col("degree")).alias("part")
        while steps is None or step + 1 < steps:
            if steps is None and difference < config.tolerance:
                break
            step += 1
            sent = ranks.join(sorted_join(light), F.col("v") == F.col("s")).select("t", part)
            if some_hubs:
                known = ranks.join(F.broadcast(hubs), F.col("v") == F.col("s")).select("s", part)
                sent = sent.unionByName(spread.join(F.broadcast(known), "s").select("t", "part"))
            got = sent.groupBy("t").agg(F.sum("part").alias("received"))
            fixed = (1 - d) / number + d * residual
            rank = F.lit(fixed) + d * F.coalesce("received", F.lit(0.0))
            after, sums = ranks.join(sorted_join(got), F.col("v") == F.col("t"), "left").select("v", "degree", F.col("rank").alias("old"), rank.alias("rank")), Observation()
            changed = F.sum(F.abs(F.col("rank") - F.col("old"))).alias("difference")
            after = after.observe(sums, changed, F.sum(F.when(F.col("degree") == 0, F.col("rank")).otherwise(0.0)).alias("lost"))
            after = table(after.select("v", "degree", "rank"), "ranks")
            drop(written)
            ranks = written = after
            difference, residual = sums.get["difference"], sums.get["lost"] / number
        return Ranks(numbered.join(sorted_join(ranks), "v").select("id", "rank"), step if steps is None else steps, difference)
    finally:
        light.unpersist()
        if spread is not None:
            spread.unpersist()
        drop(real, degrees)
