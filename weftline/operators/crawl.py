"""A crawl pass: fetched pages to links and text, then to the graph and the index.

Everything up to the payload is one narrow plan. The two consumers each read it, so it is written once
as a scratch table between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..schemas import EDGES, LINKS, instant
from ..sources import fetch
from ..sources.scratch import table
from .linkgraph import LinkGraph
from .textindex import index_docs


def extract_links(pages: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """`pages`: url, raw_content. Adds nofollow_links and links: distinct, in order, without excluded
    types; with `hosts` (host, private), links to other hosts stay only if those are known and public."""
    found = pages.withColumn("__found", html.page_links(F.col("url"), F.col("raw_content")))
    if hosts is not None:
        found = _public_only(found.withColumn("__host", urls.host(html.page_base(F.col("url"), F.col("raw_content")))), hosts)
    return _split(found)


def _split(found: DataFrame) -> DataFrame:
    """__found as nofollow_links and links."""
    nofollow = F.transform(F.filter("__found", lambda a: a["nofollow"]), lambda a: a["url"])
    follow = F.transform(F.filter("__found", lambda a: ~a["nofollow"]), lambda a: a["url"])
    return found.withColumn("nofollow_links", nofollow).withColumn("links", follow).drop("__found", "__host")


def _public_only(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links on the page's host (__host), or on hosts that are public. Hosts are joined once each, not once a link."""
    own = found
    targets = own.select("url", F.explode(F.array_distinct(F.transform("__found", lambda a: F.lower(urls.host(a["url"]))))).alias("target"))
    public = targets.join(hosts.where(~F.col("private")), F.col("target") == F.col("host")).groupBy(F.col("url").alias("__url")).agg(F.collect_set("target").alias("__public"))
    kept = F.filter("__found", lambda a: (urls.host(a["url"]) == F.col("__host")) | F.array_contains(F.coalesce("__public", F.expr("cast(array() as array<string>)")), F.lower(urls.host(a["url"]))))
    return own.join(public, F.col("url") == F.col("__url"), "left").withColumn("__found", kept).drop("__url", "__public")


def exploded_links(pages: DataFrame) -> DataFrame:
    """One row per page and link: url, ordinal, link, nofollow."""
    return pages.select("url", F.posexplode(html.page_links(F.col("url"), F.col("raw_content"))).alias("ordinal", "a")).select("url", "ordinal", F.col("a.url").alias("link"), F.col("a.nofollow").alias("nofollow"))


def extract_text(pages: DataFrame, *, unended: bool = True) -> DataFrame:
    """Adds title and text_content. `unended`: see html.unescape."""
    return pages.withColumn("title", html.title(F.col("raw_content"), unended)).withColumn("text_content", html.text(F.col("raw_content"), unended))


def documents_of(payload: DataFrame, now) -> DataFrame:
    """Index rows of a payload."""
    return payload.select("link_id", "url", "title", F.col("text_content").alias("content"), instant(now).alias("indexed_at"))


@dataclass(frozen=True)
class Pass:
    graph: LinkGraph
    docs: DataFrame
    processed: int


def crawl(graph: LinkGraph, docs: DataFrame, responses: DataFrame, now, *, stale_before=None, hosts: DataFrame | None = None, start: str | None = None, end: str | None = None) -> Pass:
    """One pass over the links of a key range that were retrieved before `stale_before`: the new graph and
    index, and how many links went through. A link whose fetch fails keeps its time and is tried again."""
    links = graph.scan_links(start, end, now if stale_before is None else stale_before)
    pages = fetch.fetched(links, responses, hosts)
    found = extract_text(pages).withColumn("__found", html.page_links(F.col("url"), F.col("raw_content"))).withColumn("__host", urls.host(html.page_base(F.col("url"), F.col("raw_content"))))
    payload = table(found.drop("raw_content"), "payload")
    narrow = payload.select("url", "__found", "__host")  # hosts are looked up without the texts
    linked = _split(narrow if hosts is None else _public_only(narrow, hosts))
    return Pass(graph.update(linked, now), index_docs(docs, documents_of(payload, now)), payload.count())


def page_graph(pages: DataFrame, now) -> LinkGraph:
    """The graph of a table of pages (url, raw_content), each an own link, and of all they point to."""
    spark = pages.sparkSession
    return LinkGraph(spark.createDataFrame([], LINKS), spark.createDataFrame([], EDGES)).update(extract_links(pages), now)
