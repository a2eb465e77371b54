"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by pattern: `assign` (a name such as password or api_key, a sign, a value),
`access` (access key ids) and `hex` (long hexadecimal runs). The method adds a fourth, `own`: long
mixed tokens that no base span overlaps and that look live.

Every candidate value is hashed, and its distinct repositories and owners in the whole corpus are counted.
A value with more than `max_owners` owners (1), or in more than `max_repositories` repositories (5) of
however few owners, is a widely copied example (`copied`); the others are owner-specific and look live
(`live`). The counts come from two merging steps (hash, owner, repository -> hash, owner -> hash), so a
value that a third of all rows hold is summed on the map side and never meets itself in one task. Values
used very often (10,000 times, or a 65,536th of all uses if that is more, so 65,536 values at most) get
their verdict by broadcast, the others by a join.

Positions are code points. A regular expression engine that gives all matches and all texts between
them gives every start as a running sum of their lengths; that is what spans() does, only for rows
that hold a match at all, in runs of about the root of their number, so that a text full of secrets costs
no square of them. Whether an `own` candidate overlaps a base span is told by the largest end before
it and the least start behind it, among the spans of its text.

Defined results: null counts as the empty text; texts without spans give 0, 0, 0, the hash of the
empty string and an empty list; null owners and repositories count as one value each; equal rows give
equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import let
from .common import table

#: The base patterns, and which group of a match is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex")

#: What the method adds: whole runs of 20 token characters or more with a letter of either case and a digit.
OWN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"

#: Quick tests that hold wherever a match is kept; they spare most rows the work on positions.
_MAY = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "own": r"[A-Za-z0-9+/_-]{20}",
}


_FOUND = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str, value_group: int, least: int) -> Column:
    """All leftmost, non-overlapping matches whose value has `least` characters or more, as an array of
    (start, end, value); positions in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(between, 1, F.size(matches)).alias("b"))
    return let(zipped, lambda z: let(_walked(z, least), _placed))  # each worked out once


def _walked(zipped: Column, least: int) -> Column:
    """Matches with the text before each, in runs: each run's length, and its matches with places from its start."""
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(zipped)))).cast("int")
    number = F.ceil(F.size(zipped) / width).cast("int")
    first = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(first, lambda i: F.aggregate(
        F.slice(zipped, i * width + 1, width),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_FOUND})").alias("found")),
        lambda acc, z: F.struct(
            (acc["at"] + F.length(z["b"]) + F.length(z["m"])).alias("at"),
            F.when(
                F.length(z["v"]) >= least,
                F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(z["b"])).alias("start"), (acc["at"] + F.length(z["b"]) + F.length(z["m"])).alias("end"), z["v"].alias("value")))),
            ).otherwise(acc["found"]).alias("found"),
        ),
    ))


def _placed(runs: Column) -> Column:
    """All matches of the runs, with places from the start of the text."""
    begins = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("begins")),
        lambda acc, run: F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")),
    )["begins"]
    moved = F.zip_with(runs, begins, lambda run, begin: F.transform(run["found"], lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end"), s["value"].alias("value"))))
    return F.flatten(moved)


def _of_kind(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def _candidates(text: Column) -> Column:
    """All candidates of a text: array of (kind, start, end, value), base kinds first."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    out = []
    for kind, pattern, group, least in (("assign", ASSIGN, 2, LEAST_VALUE), ("access", ACCESS, 0, LEAST_ACCESS), ("hex", HEX, 0, LEAST_HEX), ("own", OWN, 0, 20)):
        found = F.when(text.rlike(_MAY[kind]), spans(text, pattern, group, least)).otherwise(none)
        if kind == "own":
            found = F.filter(found, lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
        out.append(F.transform(found, _of_kind(kind)))
    return F.concat(*out)


def candidates(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with `found`: the base spans and all `own` candidates, values as two hashes."""
    keep = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = F.lit(False)
    for pattern in _MAY.values():
        may = may | text.rlike(pattern)
    found = F.when(may, _candidates(text)).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"))
    hashed = F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h1"), F.crc32(s["value"].cast("binary")).alias("h2")))
    return docs.select(*keep, hashed.alias("found"))


def _free(spread: DataFrame) -> DataFrame:
    """Rows (__row, kind, start, end, ...) without the own candidates that overlap a base span of their text."""
    ordered, base = Window.partitionBy("__row").orderBy("start", "end", "kind"), F.col("kind") != "own"
    before = F.max(F.when(base, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    met = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    return spread.withColumn("__met", met).where(base | ~F.col("__met")).drop("__met")


def ownership(spread: DataFrame) -> DataFrame:
    """h1, h2, n_owners, n_repositories, n_uses for every candidate hash of rows (h1, h2, owner, repository)."""
    per_repository = spread.groupBy("h1", "h2", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    per_owner = per_repository.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return per_owner.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("uses").alias("n_uses"))


OFTEN = 10_000
SPANS = "array<struct<kind:string,start:int,end:int,n_owners:bigint,n_repositories:bigint,verdict:string>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", owner_col: str = "source", repository_col: str | None = None, text_col: str = "text", max_owners: int = 1, max_repositories: int = 5) -> DataFrame:
    """One row per row of docs: id, `spans` (array of kind, start, end, n_owners, n_repositories, verdict).

    Base spans are all there; `own` spans only where the value looks live. The repository of a row is its id
    if no column is named. Only candidates are shuffled, not texts."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(owner_col).alias("owner"), F.col(repository_col or id_col).alias("repository"), F.col(text_col).alias("text"))
    found = table(candidates(slim).withColumn("__row", F.monotonically_increasing_id()), "secret-candidates")
    spread = table(_free(found.where(F.size("found") > 0).select("__row", "owner", "repository", F.explode("found").alias("s")).select("__row", "owner", "repository", "s.*")), "secret-spans")
    stats = table(ownership(spread), "secret-owners")
    uses = stats.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).first()[0]
    often = F.col("n_uses") >= max(OFTEN, -(-uses // 65_536))
    hot = F.broadcast(stats.where(often))  # at most 65,536
    named = spread.join(hot, ["h1", "h2"]).unionByName(spread.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(stats.where(~often), ["h1", "h2"]))
    judged = (
        named.withColumn("verdict", F.when((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories), "live").otherwise("copied"))
        .where((F.col("kind") != "own") | (F.col("verdict") == "live"))
        .groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end", "n_owners", "n_repositories", "verdict")).alias("spans"))
    )  # fmt: skip  the spans of one text
    return found.select("__row", "id").join(judged, "__row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind in the order base kinds, own; comma-joined."""
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
