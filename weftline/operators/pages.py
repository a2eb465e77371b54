"""Pages of the search site, as text: a start page, results, a form for new links, messages. Only the rows of
one page of results come to the driver."""

from __future__ import annotations

from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame

from ..schemas import never
from . import textindex
from .linkgraph import LinkGraph, submitted

_FRAME = "<!DOCTYPE html>\n<html lang=\"en\"><head><meta charset=\"utf-8\"><title>{title}</title></head>\n<body>\n{body}\n</body></html>\n"
_FORM = '<form action="/search" method="get"><input type="search" name="q" value="{terms}"><button>Search</button></form>'
_SUBMIT = '<form action="/submit" method="post"><input type="url" name="link"><button>Add</button></form>'


def _page(title: str, *parts: str) -> str:
    return _FRAME.format(title=escape(title), body="\n".join(p for p in parts if p))


def home_page() -> str:
    return _page("Search", _FORM.format(terms=""), '<p><a href="/submit">Add a page</a></p>')


def message_page(title: str, message: str, terms: str = "") -> str:
    return _page(title, _FORM.format(terms=escape(terms)), f"<p>{escape(message)}</p>")


def submit_page(message: str = "") -> str:
    return _page("Add a page", f"<p>{escape(message)}</p>" if message else "", _SUBMIT)


def results_page(terms: str, results: textindex.Results) -> str:
    """The rows of one page of results, with links to its neighbours. Summaries are escaped and marked already."""
    pages = results.pages
    items = [f'<li><a href="{escape(r["url"])}">{escape(r["title"])}</a><p>{r["summary"]}</p></li>' for r in results.rows.collect()]
    count = f"<p>{pages['from']} to {pages['to']} of {pages['total']}</p>"
    turn = [f'<a href="{escape(pages[k])}">{word}</a>' for k, word in (("prev", "Previous"), ("next", "Next")) if pages[k]]
    return _page(f"{terms} - Search", _FORM.format(terms=escape(terms)), count, "<ol>", *items, "</ol>", " ".join(turn))


@dataclass(frozen=True)
class Site:
    """Answers to requests, from an index and a link graph."""

    index: textindex.Index
    graph: LinkGraph
    page: int = textindex.PAGE
    summary_length: int = 256

    def search(self, terms: str, offset: int = 0) -> str:
        """A page of results; a message where there is none, or where the search fails."""
        try:
            results = textindex.run_query(self.index, terms, offset, page=self.page, summary_length=self.summary_length)
            return results_page(terms, results) if results.pages["total"] else message_page("Search", "Nothing was found.", terms)
        except Exception:  # a visitor is told that it failed, not how
            return message_page("Search", "The search could not be done. Please try again later.", terms)

    def submit(self, link: str) -> tuple[Site, str]:
        """The site with the link in its graph, and the page that says so; http and https alone are taken."""
        spark = self.graph.links.sparkSession
        good: DataFrame = submitted(spark.createDataFrame([(link.strip(),)], "url string")).select("url")
        if not good.take(1):
            return self, submit_page("This is not the address of a web page.")
        graph = self.graph.upsert_links(good.withColumn("retrieved_at", never()))
        return Site(self.index, graph, self.page, self.summary_length), submit_page("The page will be visited.")
