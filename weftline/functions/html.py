"""HTML as column expressions. Only entities need Python, and only texts with an ampersand go there."""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls

#: What counts as a base element, an anchor, nofollow and a title. d: only a line feed ends a
#: line; u with i: case folds beyond ASCII. A dot does not match a line feed.
BASE = r"""(?iud)<base.*?href[\t\n\f\r ]*?=[\t\n\f\r ]*?"(.*?)[\t\n\f\r ]*?\""""
ANCHOR = r"""(?iud)<a.*?href[\t\n\f\r ]*?=[\t\n\f\r ]*?"[\t\n\f\r ]*?(.*?)[\t\n\f\r ]*?".*?>"""
NOFOLLOW = r"""(?iud)rel[\t\n\f\r ]*?=[\t\n\f\r ]*?"?nofollow"?"""
TITLE = r"(?iud)<title.*?>(.*?)</title>"
#: Fixed value: elements whose content is not text.
SILENT = ("frame", "frameset", "iframe", "noembed", "noframes", "noscript", "nostyle", "object", "script", "style")
_SILENT = rf"(?is)<({'|'.join(SILENT)})\b[^>]*>.*?</\1[\t\n\f\r ]*>"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""(?s)</?[A-Za-z!?](?:"[^"]*"|'[^']*'|[^'">])*>"""
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(_html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_ended(text: pd.Series) -> pd.Series:
    """Whole entities only; a name that is not in the table stays, even where it begins with one that is."""
    decoded = lambda found: _html.unescape(found[0]) if found[0][1] == "#" else html5.get(found[0][1:], found[0])
    return text.map(lambda t: _ENTITY.sub(decoded, t), na_action="ignore")


def unescape(text: Column, unended: bool = True) -> Column:
    """Entities decoded once; with `unended`, also old ones that lack their semicolon (&amp at the end of a cut text)."""
    return F.coalesce((_unescape if unended else _unescape_ended)(F.when(text.contains("&"), text)), text)


def escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def collapsed(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"[\t\n\f\r ]+", " ")


def trimmed(text: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def stripped(html: Column) -> Column:
    """The text without comments, tags and the content of silent elements; nothing takes their place."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _COMMENT, ""), _SILENT, ""), _TAG, "")


def base_href(html: Column) -> Column:
    """What a base element gives; empty without one."""
    return F.regexp_extract(html, BASE, 1)


def anchors(html: Column) -> Column:
    """Array of (href, nofollow) in order. The flag is read off the whole match, which may begin at an
    earlier tag that starts with <a."""
    tags, hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    return F.transform(F.arrays_zip(tags.alias("tag"), hrefs.alias("href")), lambda z: F.struct(z["href"].alias("href"), z["tag"].rlike(NOFOLLOW).alias("nofollow")))


def raw_title(html: Column) -> Column:
    """The title as it stands, null without one. A title over several lines does not count."""
    return F.when(html.rlike(TITLE), F.regexp_extract(html, TITLE, 1))


def title(html: Column, unended: bool = True) -> Column:
    return trimmed(unescape(collapsed(stripped(F.coalesce(raw_title(html), F.lit("")))), unended))


def text(html: Column, unended: bool = True) -> Column:
    """All text of a page: tags gone, white space collapsed, entities decoded, trimmed."""
    return trimmed(unescape(collapsed(stripped(html)), unended))


def page_base(url: Column, html: Column) -> Column:
    """What a page's references are relative to: its base element, itself resolved against the page, or
    the page's own URL."""
    return urls.let(
        F.trim(base_href(html)),
        lambda declared: F.when(declared == "", url).otherwise(F.coalesce(urls.resolve(url, urls.with_slash(declared)), url)),
    )


def page_links(url: Column, html: Column) -> Column:
    """Distinct candidates of a page: array of (url, nofollow), first occurrence first; http and https
    only, without fragments and excluded file types."""
    found = urls.let(
        urls.parsed(page_base(url, html)),
        lambda base: F.transform(
            anchors(html), lambda a: F.struct(urls.let(urls.parsed(a["href"]), lambda ref: urls.without_fragment(urls.resolved(base, ref))).alias("url"), a["nofollow"].alias("nofollow"))
        ),
    )
    return urls.let(F.filter(found, _wanted), _first_of_each)


def _wanted(a: Column) -> Column:
    return a["url"].isNotNull() & a["url"].rlike("\\A(?i:https?):") & ~urls.excluded(a["url"])


def _first_of_each(found: Column) -> Column:
    names = F.array_distinct(F.transform(found, lambda a: a["url"]))
    return F.transform(names, lambda n: F.get(F.filter(found, lambda a: a["url"] == n), F.lit(0)))
