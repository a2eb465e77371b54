"""Stores, services, pages, cursors and detectors."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.errors import NoPartition
from weftline.operators import pages, textindex
from weftline.operators.linkgraph import Cursor, LinkGraph
from weftline.operators.partition import FixedPartition, KeyRange, RecordPartition
from weftline.schemas import EDGES, FETCH, LINKS, link_id
from weftline.sources import fetch, stores
from weftline.streaming import services

NOW = datetime(2024, 2, 1)
HTML = '<html><title>{0}</title><a href="/{1}">x</a> Words of {0}.</html>'


def stored(spark, uri, *names):
    links = spark.createDataFrame([(f"http://site/{n}",) for n in names], "url string").select(link_id(F.col("url")).alias("id"), "url", F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz").alias("retrieved_at"))
    stores.save_graph(LinkGraph(links, spark.createDataFrame([], EDGES)), uri)


def responses(spark, *pairs):
    return spark.createDataFrame([(f"http://site/{a}", 200, "text/html", HTML.format(a, b), None) for a, b in pairs], FETCH)


def test_store_commits_at_once(spark, tmp_path, monkeypatch):
    uri = f"parquet:{tmp_path}/store"
    stored(spark, uri, "a", "b")
    before = stores.open_graph(spark, uri)
    services.crawl_once(spark, uri, responses(spark, ("a", "b"), ("b", "a")), NOW)
    assert before.links.count() == 2 and before.edges.count() == 0  # the commit before can still be read
    after = stores.open_graph(spark, uri)
    assert after.edges.count() == 2 and stores.open_docs(spark, uri).count() == 2

    def fails(*_):
        raise OSError("no space")

    monkeypatch.setattr(stores, "_commit", fails)
    with pytest.raises(OSError):
        stores.write_tables({"links": after.links.limit(0), "edges": after.edges.limit(0)}, uri)
    monkeypatch.undo()
    assert stores.open_graph(spark, uri).links.count() == 2 and stores.open_graph(spark, uri).edges.count() == 2
    number = stores._commits(spark, uri.partition(":")[2])[-1]
    with pytest.raises(RuntimeError):
        stores._commit(spark, uri.partition(":")[2], number, {})
    for _ in range(3):
        stores.save_graph(stores.open_graph(spark, uri), uri)
    assert len(stores._commits(spark, uri.partition(":")[2])) == 2 and stores.open_docs(spark, uri).count() == 2
    stores.drop_tables(spark, uri)
    assert stores.open_graph(spark, uri).links.count() == 0


def test_rank_stream(spark, tmp_path):
    """Two pages that point to each other share the rank; what came after the clock's time does not count."""
    uri = f"parquet:{tmp_path}/store"
    stored(spark, uri, "a", "b")
    services.crawl_once(spark, uri, responses(spark, ("a", "b"), ("b", "a")), NOW)
    query = services.rank_stream(spark, uri, f"{tmp_path}/checkpoint", interval="1 second", clock=lambda: NOW + timedelta(days=1))
    try:
        for _ in range(120):
            if {r.pagerank for r in stores.open_docs(spark, uri).collect()} == {0.5}:
                break
            time.sleep(0.5)
        assert query.exception() is None and {r.pagerank for r in stores.open_docs(spark, uri).collect()} == {0.5}
    finally:
        query.stop()
    assert services.rank_once(spark, uri, datetime(2022, 1, 1)) == 0


def test_group_ends_with_its_first_failure(spark):
    def fails(batch, _):
        raise ValueError("the service failed")

    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    earlier = rate.writeStream.format("noop").start()
    earlier.stop()  # a query of the session that ended before says nothing about the group
    healthy = rate.writeStream.format("noop").start()
    failing = rate.writeStream.foreachBatch(fails).start()
    with pytest.raises(Exception, match="the service failed"):
        services.run_group(spark, healthy, failing)
    assert not healthy.isActive and not failing.isActive


def test_deferral_and_detectors(spark, tmp_path):
    found = RecordPartition("crawler-1", lambda: ["x", "y"])
    assert found.extents() == KeyRange.full(2).extents(1) == FixedPartition(1, 2).extents()
    missing = RecordPartition("crawler-1", lambda: [])
    with pytest.raises(NoPartition):
        services.extents_of(missing)
    with pytest.raises(NoPartition):
        RecordPartition("crawler", lambda: ["x"]).extents()

    def unreachable():
        raise OSError("no name server")

    with pytest.raises(NoPartition):
        RecordPartition("crawler-0", unreachable).extents()
    peers = []
    late = RecordPartition("crawler-0", lambda: peers.append("x") or peers[1:])
    assert services.extents_of(late, wait=0.01) == KeyRange.full(1).extents(0) and services.extents_of(None) == (None, None)
    uri = f"parquet:{tmp_path}/store"
    stored(spark, uri, "a", "b")
    responses(spark, ("a", "b"), ("b", "a")).write.parquet(f"{tmp_path}/fetch")
    query = services.crawl_stream(spark, uri, f"{tmp_path}/fetch", f"{tmp_path}/c", clock=lambda: NOW, once=True, partition=FixedPartition(0, 2))
    query.awaitTermination()
    low = KeyRange.full(2).extents(0)[1]
    assert {r.link_id < low for r in stores.open_docs(spark, uri).collect()} <= {True}


def test_fetcher_hook(spark):
    links = spark.createDataFrame([("http://a/",), ("http://b/x.png",), ("http://c/",), ("http://d/",)], "url string").select(link_id(F.col("url")).alias("id"), "url", F.lit(None).cast("timestamp_ntz").alias("retrieved_at"))

    def get(url):
        if "c" in url:
            raise TimeoutError("slow")
        return (404 if "d" in url else 200), "text/html", f"body of {url}"

    got = {r.url: r for r in fetch.responses_of(links, get).collect()}
    assert set(got) == {"http://a/", "http://c/", "http://d/"} and got["http://c/"].error == "TimeoutError: slow" and got["http://d/"].status == 404
    assert [r.raw_content for r in fetch.fetched(links, fetch.responses_of(links, get)).collect()] == ["body of http://a/"]


def test_private_sources_are_not_fetched(spark):
    links = spark.createDataFrame([("http://a/",), ("http://b/",), ("http://c/",)], "url string").select(link_id(F.col("url")).alias("id"), "url", F.lit(None).cast("timestamp_ntz").alias("retrieved_at"))
    hosts = fetch.private_hosts(spark.createDataFrame([("a", "8.8.8.8"), ("b", "8.8.8.8"), ("b", "10.0.0.1")], "host string, ip string"))
    pages_ = spark.createDataFrame([(f"http://{h}/", 200, "text/html", h, None) for h in "abc"], FETCH)
    assert [r.raw_content for r in fetch.fetched(links, pages_, hosts).collect()] == ["a"]


def test_cursor(spark):
    links = spark.range(100).select(F.col("id").cast("string").alias("url")).select(link_id(F.col("url")).alias("id"), "url", F.lit(NOW).cast("timestamp_ntz").alias("retrieved_at"))
    graph = LinkGraph(links, spark.createDataFrame([], EDGES))
    with graph.stream_links(retrieved_before=NOW + timedelta(days=1)) as rows:
        assert len({r.url for r in rows}) == 100
    cursor = Cursor(graph.links)
    assert next(cursor).url and cursor.close() is None and list(cursor) == [] and list(graph.stream_edges()) == []


def test_site(spark):
    schema = "link_id string, url string, title string, content string, indexed_at timestamp_ntz, pagerank double"
    docs = spark.createDataFrame([(f"{k:02}", f"http://{k}/?a=1&b=2", "T & U" if k else "", "Some cats <b>. More.", None, k / 10) for k in range(5)], schema)
    site = pages.Site(textindex.Index.build(docs), LinkGraph(spark.createDataFrame([], LINKS), spark.createDataFrame([], EDGES)), page=2)
    first = site.search("cats")
    assert "1 to 2 of 5" in first and "T &amp; U" in first and "<em>cats</em> &lt;b&gt;" in first and "http://4/?a=1&amp;b=2" in first and "Previous" not in first
    last = site.search("cats", 4)
    assert "5 to 5 of 5" in last and "http://0/" in last and "Next" not in last and "offset=2" in last
    assert "Nothing was found" in site.search("dogs<") and "dogs&lt;" in site.search("dogs<")
    broken = pages.Site(textindex.Index(docs, docs, 1, 1.0), site.graph)
    assert "could not be done" in broken.search("cats") and "q" in pages.home_page() and "/submit" in pages.home_page()
    same, page = site.submit("mailto:x")
    assert same is site and "not the address" in page
    more, page = site.submit(" http://new/#top ")
    assert [r.url for r in more.graph.links.collect()] == ["http://new/"] and "will be visited" in page
