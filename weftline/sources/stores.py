"""Backends behind URIs: memory:, parquet:<folder>, jdbc:<url>. Scans push ranges and times down to them.

A Parquet store keeps each table in numbered versions, and commits: small files that name the version of
every table. A write makes new versions first and its commit last, by a rename that fails if another
writer has taken the number. So all tables change at once, a crash leaves the commit before, and readers of
that commit are not disturbed: versions go when they are two commits old."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.linkgraph import LinkGraph
from ..schemas import DOCS, EDGES, LINKS

TABLES = {"links": LINKS, "edges": EDGES, "docs": DOCS}


def _path(path: str, spark: SparkSession):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits that a store keeps, ascending."""
    where, system = _path(f"{root}/commits", spark)
    found = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n) for n in found if n.isdigit())


def _committed(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    """Folders of the tables of a commit."""
    where, system = _path(f"{root}/commits/{number:012d}", spark)
    stream = system.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, number: int, tables: dict[str, str]) -> None:
    temporary, system = _path(f"{root}/commits/.{uuid.uuid4().hex}", spark)
    system.mkdirs(temporary.getParent())
    stream = system.create(temporary)
    stream.write(json.dumps(tables).encode())
    stream.close()
    final = _path(f"{root}/commits/{number:012d}", spark)[0]
    if system.exists(final) or not system.rename(temporary, final):
        system.delete(temporary, False)
        raise RuntimeError(f"another writer has made commit {number} of {root}")


def read_table(spark: SparkSession, uri: str, name: str) -> DataFrame:
    """A stored table; an empty one where a store is new."""
    kind, _, rest = uri.partition(":")
    if kind == "memory":
        return spark.createDataFrame([], TABLES[name])
    if kind == "parquet":
        numbers = _commits(spark, rest)
        path = _committed(spark, rest, numbers[-1]).get(name) if numbers else None
        return spark.read.schema(TABLES[name]).parquet(f"{rest}/{path}") if path else spark.createDataFrame([], TABLES[name])
    if kind == "jdbc":
        return spark.read.format("jdbc").option("url", uri).option("dbtable", name).load()
    raise ValueError(f"no store for {uri!r}")


_KEYS = {"links": "id", "edges": "src", "docs": "link_id"}


def write_tables(tables: dict[str, DataFrame], uri: str) -> None:
    """Replace stored tables, all at once in a Parquet store. Rows are ranged by key, so that scans of a key range
    touch few files."""
    kind, _, rest = uri.partition(":")
    if kind == "parquet":
        spark = next(iter(tables.values())).sparkSession
        numbers = _commits(spark, rest)
        before = _committed(spark, rest, numbers[-1]) if numbers else {}
        number, after = numbers[-1] + 1 if numbers else 0, dict(before)
        for name, df in tables.items():
            after[name] = f"{name}/{number:012d}-{uuid.uuid4().hex[:8]}"
            df.repartitionByRange(_KEYS[name]).sortWithinPartitions(_KEYS[name]).write.parquet(f"{rest}/{after[name]}")
        _commit(spark, rest, number, after)
        for old in numbers[:-1]:  # the commit before stays for those who read it
            for path in set(_committed(spark, rest, old).values()) - set(before.values()) - set(after.values()):
                where, system = _path(f"{rest}/{path}", spark)
                system.delete(where, True)
            where, system = _path(f"{rest}/commits/{old:012d}", spark)
            system.delete(where, False)
    elif kind == "jdbc":
        for name, df in tables.items():
            df.write.format("jdbc").option("url", uri).option("dbtable", name).option("truncate", True).mode("overwrite").save()
    elif kind != "memory":
        raise ValueError(f"no store for {uri!r}")


def write_table(df: DataFrame, uri: str, name: str) -> None:
    write_tables({name: df}, uri)


def open_graph(spark: SparkSession, uri: str) -> LinkGraph:
    return LinkGraph(read_table(spark, uri, "links"), read_table(spark, uri, "edges"))


def save_graph(graph: LinkGraph, uri: str) -> None:
    write_tables({"links": graph.links, "edges": graph.edges}, uri)


def open_docs(spark: SparkSession, uri: str) -> DataFrame:
    return read_table(spark, uri, "docs")


def drop_tables(spark: SparkSession, uri: str) -> None:
    """Remove what a Parquet store holds; nothing to do for others."""
    kind, _, rest = uri.partition(":")
    if kind == "parquet":
        for name in (*TABLES, "commits"):
            where, system = _path(f"{rest}/{name}", spark)
            system.delete(where, True)
