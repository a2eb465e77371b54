"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lmscore, media, mixing, ngramjoin, quality, secrets, sharding, suffixes, tokencount
from .common import crc_mod, table, word_count


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = table(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = mixing.mixture_plan(sized, mixing.cyclic_weights(sized))
    mixed = mixing.with_repetitions(sized, plan, id_col="id", source_col="source", size=F.col("size"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"))


def op2_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", sharding.byte_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.contiguous_shards(table(sized, "shard-sizes"), order=["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Model:
    """The model of op4 and of the pipeline: learned from labels outside the held-out fifth."""
    return quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"), lambda doc_id: crc_mod(doc_id, 5) != 0)


#: Documents that score less are rejected.
QUALITY_CUT = 0.3


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.scored(docs, quality_model(docs, spark, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scores, n = lmscore.score_all(docs, ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs)
    base = F.filter("spans", lambda s: s["kind"] != "own")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(kind) for kind in secrets.KINDS], F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard_bytes": op2_shard_bytes,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_ogg_media": op5_ogg_media,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_suffix_array": op9_suffix_array,
    "op10_secrets": op10_secrets,
}
