"""Tables that cut lineage: written to the folder all executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has run: the table holds the result, so none is read again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet and read it back. A lost executor then costs no recomputation beyond here,
    plans stay short in loops, and every branch of a later plan sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def sorted_join(df: DataFrame) -> DataFrame:
    """`df`, to be joined by sorting whatever size it is said to have. A scratch table is told by its compressed files,
    a small part of what it takes in memory; a side that grows with the input would be broadcast through the driver."""
    return df.hint("merge")


def drop(*tables: DataFrame) -> None:
    """Delete tables that no plan still to run reads; a frame that table() has not made is left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _written:
            _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            _delete(path, spark)
        except Exception:  # the session may be gone already; the other tables still go
            continue
