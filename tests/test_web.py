"""Links, titles, text, URLs, networks, fetching."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import html, networks, urls
from weftline.operators import crawl
from weftline.operators.linkgraph import LinkGraph
from weftline.schemas import DOCS, EDGES, LINKS
from weftline.sources import fetch, stores
from weftline.streaming import services


def one(spark, expression, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(expression(*[F.col(c) for c in df.columns])).first()[0]


BASE = "http://h.example.com/d/p.html"


@pytest.mark.parametrize("target, expected", [
    ("/x", "http://h.example.com/x"), ("y", "http://h.example.com/d/y"), ("../z", "http://h.example.com/z"), ("//o.example.net/q", "http://o.example.net/q"),
    ("?a=1", "http://h.example.com/d/p.html?a=1"), ("https://o.example.net", "https://o.example.net"), ("/für", "http://h.example.com/f%C3%BCr"), ("/the,", "http://h.example.com/the,"),
    ("", None), ("%zz", None), ("mailto:a@b", "mailto:a@b"), ("./a/./b/../c", "http://h.example.com/d/a/c"), ("/a/..", "http://h.example.com/"), ("..", "http://h.example.com/"),
    ("g/", "http://h.example.com/d/g/"), ("../../../g", "http://h.example.com/g"), ("/a b", "http://h.example.com/a%20b"), ("HTTP://X/y", "http://X/y"), ("x:y/z", "x:y/z"),
])
def test_resolve(spark, target, expected):
    assert one(spark, urls.resolve, BASE, target) == expected


def test_resolve_fragment_and_base_without_path(spark):
    assert one(spark, lambda b, t: urls.without_fragment(urls.resolve(b, t)), BASE, "#top") == BASE
    assert one(spark, urls.resolve, "http://h.example.com", "y") == "http://h.example.com/y"


@pytest.mark.parametrize("page, hrefs, nofollow", [
    ('<a href="/a">1</a><A HREF = "b.html" rel=nofollow>2</A>', ["/a", "b.html"], [False, True]),
    ("<a href='/single'>4</a>", [], []), ('<a\nhref="/nl">5</a>', [], []), ('<a href="">6</a>', [""], [False]),
    ('<abbr>rel=nofollow</abbr><a href="/d">7</a>', ["/d"], [True]), ('<a href="/e">8</a> rel=nofollow', ["/e"], [False]), ('<a x\rhref="/u">t</a>', ["/u"], [False]),
    ('<a href="#top">9</a><a href="//h.example.net/x#f">10</a>', ["#top", "//h.example.net/x#f"], [False, False]),
])
def test_anchors(spark, page, hrefs, nofollow):
    got = one(spark, html.anchors, page)
    assert [g.href for g in got] == hrefs and [g.nofollow for g in got] == nofollow


@pytest.mark.parametrize("page, title", [
    ("<title>A &amp; B</title>", "A & B"), ('<TITLE lang="x"> hi </TITLE>', "hi"), ("<title>a\nb</title>", ""), ("<title><b>t</b></title>", "t"), ("none", ""), ("<title>a&nbsp;</title>", "a"),
])
def test_title(spark, page, title):
    assert one(spark, html.title, page) == title


def test_text(spark):
    page = '<p>One</p><!-- no -->\n <script>var t="</p>";</script>two &lt;b&gt; <style>p{}</style>three'
    assert one(spark, html.text, page) == "One two <b> three"
    assert one(spark, html.text, "") == "" and one(spark, html.text, None) is None
    assert one(spark, html.escape, """<a href="x">'&""") == "&lt;a href=&#34;x&#34;&gt;&#39;&amp;"


def test_entities_without_their_semicolon(spark):
    """read as in the reference, or left, as the SQL of extract_text and flagship has them."""
    page = "<title>a&amp;amp; &lt;b&#x41;&nope; c&amp</title>"
    assert one(spark, html.title, page) == "a&amp; <bA&nope; c&"
    assert one(spark, lambda c: html.title(c, unended=False), page) == one(spark, lambda c: html.text(c, unended=False), page) == "a&amp; <bA&nope; c&amp"
    found = crawl.extract_text(spark.createDataFrame([(page,)], "raw_content string"), unended=False).first()
    assert found.title == found.text_content == "a&amp; <bA&nope; c&amp"


@pytest.mark.parametrize("url, out", [("http://x/a.PNG", True), ("http://x/.css", True), ("http://x/a.png?x=1", False), ("http://x/a.jsx", False), ("http://x/a.js\n", False)])
def test_excluded(spark, url, out):
    assert one(spark, urls.excluded, url) is out


def test_hosts(spark):
    assert one(spark, urls.host, "http://u:p@H.example.com:80/x") == "H.example.com"
    assert one(spark, urls.host, "http://[::1]:8/") == "::1" and one(spark, urls.host, "/x") == ""
    assert one(spark, urls.with_slash, "") is None and one(spark, urls.with_slash, "a") == "a/"


@pytest.mark.parametrize("ip, private", [
    *[(x, True) for x in ("127.0.0.1", "10.1.2.3", "172.16.0.1", "172.31.255.255", "192.168.1.1", "169.254.0.1", "0.1.2.3", "255.255.255.255", "::1", "fe80::1", "fd00::1", "0:0:0:0:0:0:0:1")],
    *[(x, False) for x in ("172.15.255.255", "172.32.0.1", "11.0.0.1", "8.8.8.8", "255.255.255.254", "2001:db8::1")], *[(x, None) for x in ("300.1.1.1", "host", "", "1::2::3")],
])
def test_private(spark, ip, private):
    assert one(spark, networks.in_networks, ip) is private


def test_page_links_order_base_and_dedupe(spark):
    page = '<base href="/p/ "><a href="x#1">a</a><a href="x#2" rel="nofollow">b</a><a href="y.png">c</a><a href="mailto:q@r">d</a><a href="/z" rel="nofollow">e</a>'
    got = crawl.extract_links(spark.createDataFrame([("http://h/a/b", page)], "url string, raw_content string")).first()
    assert got.links == ["http://h/p/x"] and got.nofollow_links == ["http://h/z"]
    odd = crawl.extract_links(spark.createDataFrame([("http://h/", None), ("http://h/", '<base href=""><a href="q">')], "url string, raw_content string")).collect()
    assert [sorted(r.links or []) for r in odd] == [[], ["http://h/q"]]


def test_foreign_hosts(spark):
    pages = spark.createDataFrame([("http://h/", '<a href="/own"><a href="http://pub/x"><a href="http://priv/x"><a href="http://unknown/x">')], "url string, raw_content string")
    hosts = fetch.private_hosts(spark.createDataFrame([("pub", "8.8.8.8"), ("priv", "10.0.0.1"), ("priv", "8.8.8.8")], "host string, ip string"))
    assert crawl.extract_links(pages, hosts).first().links == ["http://h/own", "http://pub/x"]


def responses(spark):
    body = '<title>T</title><a href="/b">b</a> some words'
    rows = [("http://h/", 200, "text/html", body, None), ("http://h/404", 404, "text/html", body, None), ("http://h/img", 200, "image/png", body, None), ("http://h/err", None, None, None, "timeout"), ("http://h/x.css", 200, "text/html", body, None)]
    return spark.createDataFrame(rows, "url string, status int, content_type string, body string, error string")


def test_crawl_pass_and_services(spark, tmp_path):
    uri = f"parquet:{tmp_path}/store"
    g = LinkGraph(spark.createDataFrame([], LINKS), spark.createDataFrame([], EDGES))
    seeds = responses(spark).select("url").withColumn("retrieved_at", F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"))
    stores.save_graph(g.upsert_links(seeds), uri)
    now = datetime(2024, 1, 1)
    assert services.crawl_once(spark, uri, responses(spark), now) == 1
    docs, graph = stores.open_docs(spark, uri).collect(), stores.open_graph(spark, uri)
    assert [(d.title, d.url) for d in docs] == [("T", "http://h/")] and "some words" in docs[0].content
    assert graph.edges.count() == 1 and graph.links.count() == 6
    assert services.crawl_once(spark, uri, responses(spark), now) == 0  # not due again
    assert services.rank_once(spark, uri, datetime(2024, 1, 2)) > 1
    ranks = stores.open_docs(spark, uri).select(F.sum("pagerank"), F.count("*")).first()
    assert abs(ranks[0] - 1) < 1e-3 and ranks[1] == 6

    folder = tmp_path / "fetch"
    responses(spark).write.parquet(str(folder))
    query = services.crawl_stream(spark, uri, str(folder), str(tmp_path / "cp"), clock=lambda: datetime(2024, 6, 1), once=True)
    query.awaitTermination()
    assert query.exception() is None
    assert str(stores.open_graph(spark, uri).links.where("url = 'http://h/'").first().retrieved_at) == "2024-06-01 00:00:00"
    stores.drop_tables(spark, uri)
    assert stores.open_docs(spark, uri).count() == 0 and stores.open_docs(spark, "memory:").schema == DOCS
    with pytest.raises(ValueError):
        stores.open_graph(spark, "other:x")


def test_event_counts_stream_equals_table(spark, tmp_path):
    events = spark.range(200).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 3 as int))").alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"))
    events.write.parquet(str(tmp_path / "e"))
    stream = services.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counted")) == key(services.event_counts(events))


def test_private_reads_an_address_once(spark):
    """each network compares a number; the text is matched once."""
    ips = spark.createDataFrame([("10.0.0.1", True), ("8.8.8.8", False), ("10.0.0.256", None), ("1.2.3", None), ("::1", True), ("2001:db8::1", False), (None, None)], "ip string, private boolean")
    found = ips.select("private", networks.in_networks(F.col("ip")).alias("found"))
    assert all(r.private == r.found for r in found.collect())
    assert spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple").count("regexp_extract") == 0
