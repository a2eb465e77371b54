"""A corpus from raw documents: quality, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents as they are; columns
beyond those pass through, whatever their names (but see `sharded`). Any column may be null. An empty table
gives an empty table in every stage; texts are read whole, whatever their length. The pipeline cannot be
put in SQL: the classifier, the embeddings and the sampling are not expressible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, mixing, ngramjoin, quality, sharding
from weftline.llm.common import table, word_count
from weftline.llm.queries import QUALITY_CUT, quality_model, read


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a number for each row, written, so that every reader sees the same numbers."""
    return table(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go. Null and empty texts are scored like any other; equal
    texts have equal scores, so repeated rows stay or go together. Without usable labels all stay."""
    return quality.accepted(docs, quality_model(docs, spark, sf_dir), QUALITY_CUT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents linked by shared 5-word shingles, the one with the smallest id stays, the first row of
    equal ids, one without an id only among its like; so one of equal rows stays. Null, empty and blank texts
    are linked with nothing and stay."""
    number = _free(docs, "__number")
    rows = _numbered(docs, number)
    grouped = ngramjoin.linked_components(rows, id_col=number).select(F.col("doc_id").alias("number"), "component_id")
    named = grouped.join(rows.select(F.col(number).alias("number"), "doc_id"), "number")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("first")).select("first.number")
    gone = table(grouped.select("number").join(first, "number", "left_anti"), "pipeline-gone")
    return ngramjoin.without_ids(rows, gone, id_col=number).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a passage of the benchmark go. Null and empty texts hold none and stay;
    equal rows stay or go together; null items and items without words are no passages."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every source at its target, by whole and seeded extra repetitions of documents. A null source is
    a source. Rows of one id and size are taken together. Texts without words weigh nothing; they are repeated
    as their source is."""
    sized = table(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = mixing.mixture_plan(sized, mixing.cyclic_weights(sized))
    prefix = _free(docs, "__mix_")
    drawn = mixing.with_repetitions(docs, plan, id_col="doc_id", source_col="source", size=word_count(F.col("text")), prefix=prefix)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}repetitions")))
    return drawn.where(F.col(f"{prefix}repetitions") > 0).select(*docs.columns, copies.alias(_free(docs, "__copy"))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: 16 contiguous shards of equal bytes, in order of the ids, null first; adds shard and slot.
    Columns of docs that have these names give way. Equal rows take places next to each other."""
    kept = docs.drop("shard", "slot")
    number = _free(kept, "__number")
    rows = _numbered(kept, number)
    sized = rows.select(F.col(number).alias("number"), "doc_id", sharding.byte_size(F.col("text")).alias("size"))
    placed = sharding.contiguous_shards(sized, order=["doc_id", "number"]).select(F.col("number").alias(number), "shard", "slot")
    return rows.join(placed.hint("merge"), number).select(*kept.columns, "shard", "slot")  # one row each: never a broadcast


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
