"""Periodic services over Structured Streaming: crawl what arrives, rank on a schedule, run as a group."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import NoPartition
from ..operators import crawl as crawling
from ..operators import textindex
from ..operators.pagerank import Config, pagerank
from ..schemas import FETCH
from ..sources import stores


@dataclass(frozen=True)
class CrawlSettings:
    interval: str = "5 minutes"
    reindex_after: timedelta = timedelta(days=7)

    def cutoff(self, now: datetime) -> datetime:
        """Links retrieved before it are due again."""
        return now - self.reindex_after


def crawl_once(spark: SparkSession, uri: str, responses: DataFrame, now: datetime, settings: CrawlSettings = CrawlSettings(), *, hosts: DataFrame | None = None, start: str | None = None, end: str | None = None) -> int:
    """One pass over a store; returns how many links went through. Same input and clock, same result:
    ids come from urls, so a repeated batch changes nothing; the three tables change at once."""
    graph, docs = stores.open_graph(spark, uri), stores.open_docs(spark, uri)
    done = crawling.crawl(graph, docs, responses, now, stale_before=settings.cutoff(now), hosts=hosts, start=start, end=end)
    stores.write_tables({"links": done.graph.links, "edges": done.graph.edges, "docs": done.docs}, uri)
    return done.processed


def extents_of(partition, wait: float | None = None) -> tuple[str | None, str | None]:
    """The key range that a detector gives; all keys without one. While it raises NoPartition the work is put off:
    it is asked again every `wait` seconds, or the error is passed on without a wait."""
    while partition is not None:
        try:
            return partition.extents()
        except NoPartition:
            if wait is None:
                raise
            time.sleep(wait)
    return None, None


def crawl_stream(spark: SparkSession, uri: str, fetch_folder: str, checkpoint: str, *, clock: Callable[[], datetime] = datetime.now, settings: CrawlSettings = CrawlSettings(), once: bool = False, partition=None, wait: float | None = 30.0) -> StreamingQuery:
    """A crawl pass for each batch of fetch files that arrives, on the interval, or once over all there is. With a
    `partition` detector, over its key range, and put off while that is not known."""
    responses = spark.readStream.schema(FETCH).parquet(fetch_folder)

    def one(batch: DataFrame, _: int) -> None:
        start, end = extents_of(partition, wait)
        crawl_once(batch.sparkSession, uri, batch, clock(), settings, start=start, end=end)

    writer = responses.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=settings.interval)).start()


def rank_once(spark: SparkSession, uri: str, now: datetime, config: Config = Config()) -> int:
    """A PageRank pass over what the store held before `now`, written to the index. Returns the superstep."""
    graph = stores.open_graph(spark, uri)
    links, edges = graph.scan_links(retrieved_before=now), graph.scan_edges(updated_before=now)
    done = pagerank(links.select("id"), edges.select("src", "dst"), config=config)
    docs = textindex.update_scores(stores.open_docs(spark, uri), done.scores.select(F.col("id").alias("link_id"), F.col("rank").alias("score")))
    stores.write_tables({"docs": docs}, uri)
    return done.superstep


def rank_stream(spark: SparkSession, uri: str, checkpoint: str, *, interval: str = "1 hour", clock: Callable[[], datetime] = datetime.now, config: Config = Config()) -> StreamingQuery:
    """A PageRank pass on the interval. The driver is the only leader there is."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, _: rank_once(batch.sparkSession, uri, clock(), config) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def event_counts(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type, late events up to the watermark; the same on a stream and a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def run_group(spark: SparkSession, *queries: StreamingQuery, poll: float = 0.2) -> None:
    """Wait for the first of these services that ends or fails; then all stop, and its error is raised. Other
    queries of the session play no part, whether they run or ended long ago."""
    try:
        while all(query.isActive for query in queries):
            time.sleep(poll)
        for query in queries:
            if query.exception() is not None:
                raise query.exception()
    finally:
        for query in queries:
            query.stop()
