"""URLs as column expressions: parts, resolution, filters. All of it stays in the JVM.

Patterns carry the flags i, u and d where the reference semantics fold case beyond ASCII and only a
line feed ends a line, and \\z where only the very end counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is neither fetched nor kept as a link.
EXCLUDED = r"(?iud)\.(?:jpg|jpeg|png|gif|ico|css|js)\z"

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
_PARTS = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
#: Characters a path keeps; all others are percent-encoded.
_KEPT = r"[A-Za-z0-9\-._~$&+,/:;=@%!'()*]"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host without user and port; empty where there is none."""
    return let(F.regexp_replace(_part(url, 2), r"\A.*@", ""), _bare)


def _bare(authority: Column) -> Column:
    return F.when(authority.startswith("["), F.regexp_extract(authority, r"\A\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(authority, r":[0-9]*\z", ""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*", "")


def with_slash(url: Column) -> Column:
    """The URL with a slash at its end; null for an empty one."""
    return F.when(url == "", F.lit(None)).when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def excluded(url: Column) -> Column:
    return url.rlike(EXCLUDED)


def malformed(url: Column) -> Column:
    """URLs that cannot be parsed: control characters, a per cent sign without two hexadecimal digits,
    a first path segment with a colon and no scheme."""
    return url.rlike(r"[\x00-\x1f\x7f]") | url.rlike(r"%(?![0-9A-Fa-f]{2})") | url.rlike(r"\A(?![A-Za-z][A-Za-z0-9+.\-]*:)[^/?#]*:")


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; it begins with a slash."""
    pieces = F.split(path, "/", -1)
    empty = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(
        pieces,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(walked, "/")
    ended = F.when(path.rlike(r"(?:\A|/)\.\.?\z") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), F.concat(F.lit("/"), F.regexp_replace(ended, r"\A/+", ""))).otherwise(path)


def encoded_path(path: Column) -> Column:
    """The path with every byte percent-encoded that a path may not hold."""
    one = lambda c: F.when(c.rlike(_KEPT), c).when(c == " ", F.lit("%20")).otherwise(F.url_encode(c))
    return F.when(path.rlike(rf"\A{_KEPT}*\z"), path).otherwise(F.array_join(F.transform(F.split(path, ""), one), ""))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def parsed(url: Column) -> Column:
    """The parts of a URL as a struct; `ok` says whether it can be parsed."""
    return let(
        F.trim(url),
        lambda u: F.struct(
            u.alias("text"), F.lower(_part(u, 1)).alias("scheme"), u.rlike(r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//").alias("has_authority"), _part(u, 2).alias("authority"),
            _part(u, 3).alias("path"), _part(u, 4).alias("query"), _part(u, 5).alias("fragment"), (~malformed(u)).alias("ok"),
        ),
    )


def resolved(base: Column, ref: Column) -> Column:
    """A parsed reference relative to a parsed base, as text (RFC 3986, section 5): null for an empty
    reference and for what cannot be parsed. The reference's fragment stays."""
    own = (ref["scheme"] != "") | ref["has_authority"]
    merged = let(F.regexp_extract(base["path"], r"(?s)\A(.*/)", 1), lambda folder: F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref["path"]))
    raw = F.when(own | ref["path"].startswith("/"), ref["path"]).when(ref["path"] == "", base["path"]).otherwise(merged)
    path = let(let(raw, lambda p: F.when(p == "", p).otherwise(without_dots(p))), encoded_path)
    query = F.when(~own & (ref["path"] == "") & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    authority = F.when(own & ~ref["has_authority"], F.lit("")).otherwise(F.concat(F.lit("//"), F.when(own, ref["authority"]).otherwise(base["authority"])))
    url = F.concat(F.when(ref["scheme"] != "", ref["scheme"]).otherwise(base["scheme"]), F.lit(":"), authority, path, query, ref["fragment"])
    opaque = (ref["scheme"] != "") & ~ref["has_authority"] & ~ref["path"].startswith("/")
    return F.when((ref["text"] == "") | ~ref["ok"] | ~base["ok"], F.lit(None)).when(opaque, ref["text"]).otherwise(url)


def resolve(base: Column, target: Column) -> Column:
    """The target relative to the base."""
    return let(parsed(base), lambda b: let(parsed(target), lambda t: resolved(b, t)))


def retained(link: Column, source_host: Column, private: Column | None = None) -> Column:
    """Links worth keeping: http or https, and on the source's host or not in a private network."""
    web = scheme(link).isin("http", "https")
    outside = ~F.coalesce(private, F.lit(False)) if private is not None else F.lit(True)
    return link.isNotNull() & web & ((host(link) == source_host) | outside)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
