"""Schemas of the stored tables, the timestamp that stands for never, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("url", T.StringType(), False), T.StructField("retrieved_at", T.TimestampNTZType(), False)])
EDGES = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False), T.StructField("updated_at", T.TimestampNTZType(), False),
])
DOCS = T.StructType([
    T.StructField("link_id", T.StringType(), False), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("indexed_at", T.TimestampNTZType()), T.StructField("pagerank", T.DoubleType()),
])
FETCH = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("error", T.StringType()),
])

NIL_ID = "00000000-0000-0000-0000-000000000000"
MAX_ID = "ffffffff-ffff-ffff-ffff-ffffffffffff"


def never() -> Column:
    """The time of a link that was never retrieved: before every cutoff, and not null."""
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


def instant(value) -> Column:
    """A time given as a Column, text or datetime."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def uuid_of(text: Column) -> Column:
    """A stable id in UUID form from the md5 of a text."""
    return F.regexp_replace(F.md5(text.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def link_id(url: Column) -> Column:
    return uuid_of(url)


def edge_id(src: Column, dst: Column) -> Column:
    return uuid_of(F.concat(src, dst))


def id_bytes(id_: Column) -> Column:
    """An id as its 16 bytes; those of the nil id where the text is none."""
    raw = F.unhex(F.replace(id_, F.lit("-"), F.lit("")))
    return F.when(F.octet_length(raw) == 16, raw).otherwise(F.unhex(F.lit("0" * 32)))


def id_from_bytes(raw: Column) -> Column:
    """16 bytes as an id in canonical form; the nil id for any other length."""
    text = F.regexp_replace(F.lower(F.hex(raw)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.octet_length(raw) == 16, text).otherwise(F.lit(NIL_ID))
