"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget in proportion to its weight, but never more than
`max_epochs` times what it has. What the clamped sources leave over goes to the others by weight,
again and again, until no target is above its cap. A target of e epochs then means floor(e) whole
repetitions of every document and a seeded sample that makes up the fraction.

The sample is taken in the order of a seeded hash: a document comes along if it still fits into what is
missing to the target. That is found in rounds. In each, the documents behind the last one that did not fit,
as far as each alone would fit, are added up until the next one does not; so a round's documents are a
range of the hash and a largest size, and all that a document needs to know are its source's ranges. A
round's end is found without sorting a source: sums for 1,024 bands of the hash show the band that holds
it, and only that band is ordered. What is missing at a round's end is less than the document that did not
fit, so a few rounds do, and in the end less is missing than any document left out has. The text never
moves, and a hot source is spread like any other.

Defined results: null text has size 0; a null source is a source; null ids hash as the empty text;
rows that share an id and a size are taken together; sources of size 0 get target 0; with no words at all every
target is 0; an empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, table, unit_bits
from .sharding import numbered

_BAND_BITS = 52 - 10  # 1,024 bands
_RANGES = "array<struct<from_bits:bigint,from_key:string,next_bits:bigint,next_key:string,most:double>>"


def water_level(sources: DataFrame, total: float, max_epochs: float) -> float:
    """The level L for which the sum of min(max_epochs * source_size, L * weight) is `total`.

    `sources`: source_size, weight. Each round clamps what is above its cap and shares the rest anew;
    only three sums leave the executors. With too little to reach `total`, infinity: all are clamped."""
    level, clamped_before = 0.0, -1
    while True:
        cap = F.col("source_size") * F.lit(float(max_epochs))
        over = (cap <= F.lit(level) * F.col("weight")) if clamped_before >= 0 else F.lit(False)
        clamped, fixed, weight = sources.agg(
            F.coalesce(F.sum(F.when(over, 1).otherwise(0)), F.lit(0)),
            F.coalesce(F.sum(F.when(over, cap).otherwise(0.0)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.lit(0.0)),
        ).first()
        if clamped == clamped_before:
            return level
        if not weight:
            return float("inf")
        level, clamped_before = max(level, (total - fixed) / weight), clamped


def mixture_plan(sized: DataFrame, weights: DataFrame, *, max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of every document) and the
    ranges (from_bits, from_key; next_bits, next_key; most): documents between these places of the hash
    order (to its end, if next is null) with at most so many words get one repetition more.

    `sized`: id, source, size, read more than once, so better a written table. `weights`: source, weight."""
    keyed = sized.select("source", "size", id_text(F.col("id")).alias("key"), unit_bits(seed, F.col("id")).alias("bits"))
    keyed = table(keyed.withColumn("band", F.shiftright("bits", _BAND_BITS).cast("int")), "mix-keyed")
    bands = table(keyed.groupBy("source", "band").agg(F.sum("size").alias("band_size")), "mix-bands")
    totals = bands.groupBy("source").agg(F.sum("band_size").alias("source_size"))
    sources = table(
        totals.join(weights.withColumnRenamed("source", "w_source"), F.expr("source <=> w_source"), "left")
        .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")),
        "mix-sources",
    )
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = water_level(sources, total, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = cap if level == float("inf") else F.least(cap, F.lit(level) * F.col("weight"))
    planned = sources.withColumn("target", F.round(target, 6)).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    ).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))

    rounds = None
    open_ = table(planned.where((F.col("extra") > 0) & (F.col("source_size") > 0)).select(F.col("source").alias("o_source"), F.col("extra").alias("gap"), F.lit(-1).cast("long").alias("from_bits"), F.lit("").alias("from_key")), "mix-open")
    while open_.take(1):
        done = table(_round(keyed, open_), "mix-round")
        one = done.where(F.col("taken") > 0).select("o_source", F.struct("from_bits", "from_key", "next_bits", "next_key", F.col("gap").alias("most")).alias("range"))
        rounds = one if rounds is None else rounds.unionByName(one)
        # a source goes on behind the document that did not fit
        open_ = table(done.where(F.col("next_bits").isNotNull()).select("o_source", (F.col("gap") - F.col("taken")).alias("gap"), F.col("next_bits").alias("from_bits"), F.col("next_key").alias("from_key")), "mix-open")
    if rounds is None:
        plan = planned.withColumn("ranges", F.expr(f"cast(array() as {_RANGES})"))
    else:
        ranges = rounds.groupBy("o_source").agg(F.collect_list("range").alias("ranges"))  # one a round
        plan = planned.join(ranges, F.expr("source <=> o_source"), "left").withColumn("ranges", F.coalesce("ranges", F.expr(f"cast(array() as {_RANGES})")))
    return table(plan.select("source", "source_size", "target", "whole", "ranges"), "mix-plan")  # of known size, so that joins with it need not move the documents


def _behind(bits, key, other_bits, other_key):
    return (bits > other_bits) | ((bits == other_bits) & (key > other_key))


def _round(keyed: DataFrame, open_: DataFrame) -> DataFrame:
    """open_ (o_source, gap, from_bits, from_key) with taken, and the place of the first document that did not
    fit, next_bits and next_key, null if the source is at its end."""
    fits = keyed.join(open_, F.expr("source <=> o_source")).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & _behind(F.col("bits"), F.col("key"), F.col("from_bits"), F.col("from_key")))
    bands = fits.groupBy("o_source", "gap", "band").agg(F.sum("size").alias("band_size"))
    upto = F.sum("band_size").over(Window.partitionBy("o_source").orderBy("band"))
    summed = table(bands.withColumn("upto", upto), "mix-bands")
    cut = summed.where((F.col("upto") > F.col("gap")) & (F.col("upto") - F.col("band_size") <= F.col("gap")))
    inside = (
        keyed.join(cut.select("o_source", "gap", F.col("band").alias("c_band"), (F.col("upto") - F.col("band_size")).alias("before")), F.expr("source <=> o_source and band = c_band"))
        .join(open_.select(F.col("o_source").alias("f_source"), "from_bits", "from_key"), F.expr("source <=> f_source"))
        .where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & _behind(F.col("bits"), F.col("key"), F.col("from_bits"), F.col("from_key")))
        .groupBy("o_source", "gap", "before", "bits", "key").agg(F.sum("size").alias("size"))
        .withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("o_source").orderBy("bits", "key")))
    )
    edge = inside.groupBy("o_source").agg(
        F.max(F.when(F.col("end") <= F.col("gap"), F.col("end"))).alias("end"), F.first("before").alias("before"),
        F.min(F.when(F.col("end") > F.col("gap"), F.struct("bits", "key"))).alias("next"),
    )
    whole = summed.groupBy("o_source").agg(F.max("upto").alias("all"))
    out = open_.join(whole.withColumnRenamed("o_source", "w_source"), F.expr("o_source <=> w_source"), "left").join(edge.withColumnRenamed("o_source", "e_source"), F.expr("o_source <=> e_source"), "left")
    taken = F.when(F.col("next").isNotNull(), F.coalesce("end", "before")).otherwise(F.coalesce("all", F.lit(0)))
    return out.select("o_source", "gap", "from_bits", "from_key", taken.cast("double").alias("taken"), F.col("next.bits").alias("next_bits"), F.col("next.key").alias("next_key"))


def with_repetitions(docs: DataFrame, plan: DataFrame, *, id_col: str, source_col: str, size: Column, seed: str = "mix", prefix: str = "") -> DataFrame:
    """`docs` with source_size, target and repetitions (0 to max_epochs) by the plan, under names with
    `prefix`; a map-side join while the plan is small enough for the session's broadcast threshold. `size`:
    the size of a row of docs, as the plan was made with."""
    # docs' own columns are one struct until the end, so that no name of theirs can clash
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs[source_col].alias("own_source"), size.alias("size"), unit_bits(seed, docs[id_col]).alias("bits"), id_text(docs[id_col]).alias("key"))
    joined = sized.join(plan, sized["own_source"].eqNullSafe(plan["source"]))
    bits, key = F.col("bits"), F.col("key")
    before_next = lambda r: r["next_bits"].isNull() | _behind(r["next_bits"], r["next_key"], bits, key)
    extra = F.exists("ranges", lambda r: _behind(bits, key, r["from_bits"], r["from_key"]) & before_next(r) & (F.col("size") <= r["most"]))
    reps = F.col("whole") + F.when(extra, 1).otherwise(0)
    return joined.select("d.*", F.col("source_size").alias(f"{prefix}source_size"), F.col("target").alias(f"{prefix}target"), reps.alias(f"{prefix}repetitions"))


def cyclic_weights(sized: DataFrame, cycle: int = 3) -> DataFrame:
    """source, weight: 1 to `cycle`, repeating, for sources by code point, null last. Sources are ranked
    over ranges, after the rows of each were merged."""
    ranked = numbered(sized.groupBy("source").agg(F.lit(1).alias("one")), [F.col("source").asc_nulls_last()], "mix-sources")
    return ranked.select("source", ((F.col("number") - 1) % cycle + 1).cast("double").alias("weight"))
