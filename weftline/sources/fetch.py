"""Fetched pages: a table (url, status, content_type, body, error) joined to the links that ask for them.

Fetching itself is a parameter: a table that something else wrote, or a function that gets one url and
runs on the executors. Links that cannot be pages are filtered before either, so they are never read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import networks, urls
from ..schemas import FETCH


def private_hosts(resolved: DataFrame, ranges: tuple[str, ...] = networks.PRIVATE) -> DataFrame:
    """`resolved`: host, ip. One row per host: whether any of its addresses is private."""
    return resolved.groupBy(F.lower("host").alias("host")).agg(F.max(F.coalesce(networks.in_networks(F.col("ip"), ranges), F.lit(True))).alias("private"))


def fetchable(links: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Links that may be fetched: no excluded file type and, given `hosts` (host, private), a host that
    resolves to a public address."""
    wanted = links.where(~urls.excluded(F.col("url")))
    if hosts is None:
        return wanted
    public = hosts.where(~F.col("private")).select(F.col("host").alias("public_host"))
    return wanted.join(public, F.lower(urls.host(F.col("url"))) == F.col("public_host"), "left_semi")


def usable() -> Column:
    """Responses that go on: no error, a status of 200 to 299, a content type that names html."""
    return F.col("error").isNull() & F.col("status").between(200, 299) & F.col("content_type").contains("html")


def fetched(links: DataFrame, responses: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Payload rows (link_id, url, retrieved_at, raw_content) of the links whose page came back."""
    pages = responses.where(usable()).select(F.col("url").alias("page_url"), F.col("body").alias("raw_content"))
    return fetchable(links, hosts).join(pages, F.col("url") == F.col("page_url")).select(F.col("id").alias("link_id"), "url", "retrieved_at", "raw_content")


def responses_of(links: DataFrame, get: Callable[[str], tuple], hosts: DataFrame | None = None) -> DataFrame:
    """The response table of the links that may be fetched. `get` returns (status, content type, body) of a url, or
    raises, which is kept as the response's error; it runs once for each link in each reading of the frame, so
    write the frame before reading it twice."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    out.append((url, *get(url), None))
                except Exception as error:  # whatever a fetcher raises is a failed fetch, not a failed job
                    out.append((url, None, None, None, f"{type(error).__name__}: {error}"))
            frame = pd.DataFrame(out, columns=["url", "status", "content_type", "body", "error"])
            yield frame.astype({"status": "Int32"})[[f.name for f in FETCH.fields]]

    return fetchable(links, hosts).select("url").mapInPandas(run, FETCH)
