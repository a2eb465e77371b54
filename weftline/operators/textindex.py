"""Text index and search.

Documents are rows; the inverted index (`Index`) is a written table of postings, one row for each term of a
document with its places by field, in order of the term in every file. Texts are cut into tokens once, when the index is
built; a query reads the postings of its terms only, by the statistics of the files, and documents are
looked up by key for the hits alone. A phrase is told by the places of its terms. Ranking is by PageRank first
or by a sum with BM25; ties go by id, so pages never overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import MissingLinkId, NotFound
from ..functions import html, text
from ..functions.urls import let
from ..schemas import instant, never
from ..sources.scratch import table

K1, B = 1.2, 0.75
PAGE = 10


# ---------------------------------------------------------------- mutations


def index_docs(docs: DataFrame, incoming: DataFrame, now=None) -> DataFrame:
    """Upsert by link_id: the new texts, and the PageRank that was there. `now` overrides indexed_at.
    Raises MissingLinkId for a document without one. One shuffle of each side on the key."""
    if incoming.where(F.col("link_id").isNull() | (F.col("link_id") == "")).take(1):
        raise MissingLinkId("a document has no link id")
    new = incoming.select("link_id", "url", "title", "content", (F.col("indexed_at") if now is None else instant(now)).alias("indexed_at"))
    old = docs.select("link_id", *[F.col(c).alias(f"old_{c}") for c in ("url", "title", "content", "indexed_at", "pagerank")])
    both = old.join(new.withColumn("given", F.lit(True)), "link_id", "full_outer")
    pick = lambda c: F.when(F.col("given"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    return both.select("link_id", *[pick(c) for c in ("url", "title", "content", "indexed_at")], F.coalesce("old_pagerank", F.lit(0.0)).alias("pagerank"))


def update_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """`scores`: link_id, score. Unknown ids get a placeholder: empty texts, never indexed."""
    both = docs.join(scores, "link_id", "full_outer")
    empty = F.lit("")
    return both.select(
        "link_id", F.coalesce("url", empty).alias("url"), F.coalesce("title", empty).alias("title"), F.coalesce("content", empty).alias("content"),
        F.coalesce("indexed_at", never()).alias("indexed_at"), F.coalesce("score", "pagerank", F.lit(0.0)).alias("pagerank"),
    )


def find_by_id(docs: DataFrame, link_id: str):
    """The document's row, or NotFound."""
    row = docs.where(F.col("link_id") == link_id).limit(1).first()
    if row is None:
        raise NotFound(f"no document {link_id}")
    return row


# ---------------------------------------------------------------- index


def postings(docs: DataFrame) -> DataFrame:
    """(link_id, field, term, pos): one row for each token of title and content."""
    both = docs.select("link_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in ("title", "content")])).alias("f"))
    return both.select("link_id", F.col("f.field").alias("field"), F.posexplode(text.tokens(F.col("f.text"))).alias("pos", "term")).select("link_id", "field", "term", "pos")


def gathered(title: Column, content: Column) -> Column:
    """The terms of one document from its tokens by field: array of (term, title, content, tf), the places in each
    field ascending. Tokens are sorted with their places, so a term's are next to each other."""
    placed = lambda f, k: F.transform(f, lambda t, i: F.struct(t.alias("term"), F.lit(k).alias("field"), i.alias("pos")))
    places = lambda run, k: F.transform(F.filter(run, lambda x: x["field"] == k), lambda x: x["pos"])

    def runs(found: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["term"] != F.get(found, i - 1)["term"]))
        of = lambda run: F.struct(run[0]["term"].alias("term"), places(run, 0).alias("title"), places(run, 1).alias("content"), F.size(run).alias("tf"))
        cut = lambda at: F.transform(at, lambda i, k: let(F.slice(found, i + 1, F.coalesce(F.get(at, k + 1), F.size(found)) - i), of))
        return F.when(F.size(found) > 0, let(begins, cut))

    return let(F.array_sort(F.concat(placed(title, 0), placed(content, 1))), runs)


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, cf): in how many documents a term occurs, and how often in all. A document tells of its own terms
    where it is read, so partial sums are shuffled, not tokens. Rows that share a link_id are one document: those, and
    those alone, meet by it first."""
    repeated = docs.groupBy("link_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("link_id").isNotNull()).select("link_id")
    if not repeated.take(1):
        return _summed(_counted(docs))
    apart = postings(docs.join(repeated, "link_id", "left_semi")).groupBy("term", "link_id").agg(F.count(F.lit(1)).alias("cf"))
    return _summed(_counted(docs.join(repeated, "link_id", "left_anti")).unionByName(apart.select("term", F.lit(1).cast("long").alias("df"), "cf")))


def _counted(docs: DataFrame) -> DataFrame:
    """(term, df, cf) of documents that do not share an id: a row for each token, and one for each term of a document."""
    every = F.concat(*[text.tokens(F.coalesce(F.col(f), F.lit(""))) for f in ("title", "content")])
    rows = lambda f, df, cf: F.transform(f, lambda t: F.struct(t.alias("term"), df.cast("long").alias("df"), cf.cast("long").alias("cf")))
    both = let(every, lambda t: F.concat(rows(t, F.lit(0), F.lit(1)), rows(F.array_distinct(t), F.col("link_id").isNotNull(), F.lit(0))))
    return docs.select(F.explode(both).alias("t")).select("t.*")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def index_subset(docs: DataFrame) -> DataFrame:
    """What an index keeps of a document: title, content and PageRank, by id."""
    return docs.select("link_id", "title", "content", "pagerank")


def external(docs: DataFrame) -> DataFrame:
    """Documents as another system takes them: ids and times as text, times in UTC."""
    stamp = F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return docs.select(F.col("link_id").alias("LinkID"), F.col("url").alias("URL"), F.col("title").alias("Title"), F.col("content").alias("Content"), stamp.alias("IndexedAt"), F.col("pagerank").alias("PageRank"))


def from_external(rows: DataFrame) -> DataFrame:
    """Documents from what external() gives."""
    stamp = F.to_timestamp_ntz("IndexedAt", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return rows.select(F.lower("LinkID").alias("link_id"), F.col("URL").alias("url"), F.col("Title").alias("title"), F.col("Content").alias("content"), stamp.alias("indexed_at"), F.col("PageRank").alias("pagerank"))


@dataclass(frozen=True)
class Index:
    """`docs` as they are, `terms`: (term, link_id, title, content, tf, len), the places of the term in each field,
    how often it occurs, and the number of tokens of the document; number and mean length of documents."""

    docs: DataFrame
    terms: DataFrame
    number: int
    mean: float

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> Index:
        """One pass over the texts, without a shuffle: a document's postings are gathered where it is read, and each
        task writes those of its documents in order of (term, document), so that queries skip all pages of the files
        but those of their terms. Documents are told apart by link_id. Written to `path`, or as a scratch table."""
        spark = docs.sparkSession
        cut = docs.select("link_id", *[text.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in ("title", "content")])
        cut, lengths = cut.withColumn("len", F.size("title") + F.size("content")), Observation()
        cut = cut.observe(lengths, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"))
        flat = cut.select("link_id", "len", F.explode(gathered(F.col("title"), F.col("content"))).alias("t"))
        ordered = flat.select("t.term", "link_id", "t.title", "t.content", "t.tf", "len").sortWithinPartitions("term", "link_id")
        if path is None:
            terms = table(ordered, "postings")
        else:
            ordered.write.mode("overwrite").parquet(path)
            terms = spark.read.schema(ordered.schema).parquet(path)
        return cls(docs, terms, lengths.get["n"], lengths.get["mean"])

    @classmethod
    def open(cls, docs: DataFrame, path: str) -> Index:
        """An index that build() wrote. The counts come from the documents' ids and the postings alone."""
        terms = docs.sparkSession.read.parquet(path)
        number, tokens = docs.agg(F.count(F.lit(1))).first()[0], terms.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        return cls(docs, terms, number, tokens / number if number else 0.0)

    def lists(self, terms: list[str]) -> DataFrame:
        """The postings of the terms."""
        return self.terms.where(F.col("term").isin(*terms)) if terms else self.terms.where(F.lit(False))


def _indexed(docs: DataFrame | Index) -> Index:
    return docs if isinstance(docs, Index) else Index.build(docs)


def match_ids(index: Index, expression: str, *, stop_words: bool = True) -> DataFrame:
    """link_id of documents with any term of the expression in title or content."""
    return index.lists(text.analysed(expression, stop_words)).select("link_id").distinct()


def phrase_ids(index: Index, expression: str) -> DataFrame:
    """link_id of documents with the terms next to each other, in order, within one field."""
    terms = text.analysed(expression)
    distinct = list(dict.fromkeys(terms))
    none = F.expr("cast(array() as array<int>)")
    at = lambda t, f: F.first(F.when(F.col("term") == t, F.col(f)), ignorenulls=True).alias(f"{f}_{distinct.index(t)}")
    both = index.lists(distinct).groupBy("link_id").agg(F.count(F.lit(1)).alias("terms"), *[at(t, f) for f in ("title", "content") for t in distinct])
    found = F.lit(False)
    for f in ("title", "content") if terms else ():
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.coalesce(f"{f}_{distinct.index(t)}", none), p + k) for k, t in enumerate(terms)])
        found = found | F.exists(F.coalesce(f"{f}_0", none), follows)
    return both.where((F.col("terms") == len(distinct)) & found).select("link_id")


def hit_ids(index: Index, query_type: str, expression: str, *, stop_words: bool = True) -> DataFrame:
    """By query type; whatever is not a phrase query is a match query."""
    return phrase_ids(index, expression) if query_type == "phrase" else match_ids(index, expression, stop_words=stop_words)


def match(docs: DataFrame | Index, expression: str, *, stop_words: bool = True) -> DataFrame:
    """Documents with any term of the expression in title or content."""
    index = _indexed(docs)
    return index.docs.join(match_ids(index, expression, stop_words=stop_words), "link_id", "left_semi")


def phrase(docs: DataFrame | Index, expression: str) -> DataFrame:
    """Documents with the terms next to each other, in order, within one field."""
    index = _indexed(docs)
    return index.docs.join(phrase_ids(index, expression), "link_id", "left_semi")


def hits(docs: DataFrame | Index, query_type: str, expression: str, *, stop_words: bool = True) -> DataFrame:
    """Documents, by query type."""
    index = _indexed(docs)
    return index.docs.join(hit_ids(index, query_type, expression, stop_words=stop_words), "link_id", "left_semi")


def bm25(docs: DataFrame | Index, expression: str, *, stop_words: bool = True) -> DataFrame:
    """(link_id, score) of documents with a term, from the postings of the terms: one aggregate by document, one
    by term (as many rows as the query has terms)."""
    index, terms = _indexed(docs), list(dict.fromkeys(text.analysed(expression, stop_words)))
    lists = index.lists(terms)
    df = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each term of the query
    per_doc = lists.groupBy("link_id").agg(F.first("len").alias("len"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k, t in enumerate(terms)])
    score, n, mean = F.lit(0.0), F.lit(index.number), F.lit(index.mean or 1.0)
    for k, t in enumerate(terms):
        tf, have = F.col(f"tf{k}"), F.lit(df.get(t, 0))
        idf = F.log(1 + (n - have + 0.5) / (have + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))
    return per_doc.select("link_id", score.alias("score"))


def search(docs: DataFrame | Index, expression: str, *, query_type: str = "match", ranking: str = "pagerank_first", offset: int = 0, limit: int | None = PAGE, stop_words: bool = True) -> DataFrame:
    """A page of results (link_id, url, title, content, indexed_at, pagerank, score) in rank order. No
    limit gives all from the offset on. `pagerank_first` breaks ties by score, `additive` ranks by
    score * (score + pagerank). Sort and limit plan as a top-k: no full sort, no full shuffle."""
    if offset < 0:
        raise ValueError("an offset cannot be negative")
    index = _indexed(docs)
    scores = bm25(index, expression, stop_words=stop_words)
    found = hit_ids(index, query_type, expression, stop_words=stop_words)
    scores = found.join(scores, "link_id", "left") if query_type == "phrase" else scores  # a match has a score, and only a match
    ranked = index.docs.join(scores, "link_id").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = F.coalesce("pagerank", F.lit(0.0))
    if ranking == "additive":
        ranked = ranked.withColumn("score", F.col("score") * (F.col("score") + rank))
        ordered = ranked.orderBy(F.desc("score"), "link_id")
    else:
        ordered = ranked.orderBy(rank.desc(), F.desc("score"), "link_id")
    paged = ordered.offset(offset) if offset else ordered
    return paged if limit is None else paged.limit(limit)


def total(docs: DataFrame | Index, expression: str, *, query_type: str = "match", stop_words: bool = True) -> int:
    """Number of hits, from the postings alone."""
    return hit_ids(_indexed(docs), query_type, expression, stop_words=stop_words).count()


def streamed(docs: DataFrame | Index, expression: str, *, query_type: str = "match", offset: int = 0, stop_words: bool = True) -> Iterator:
    """The number of hits, then all hits from the offset on in rank order, one at a time, without their PageRank.
    Rows leave the executors partition by partition; closing the iterator ends it."""
    index = _indexed(docs)
    yield total(index, expression, query_type=query_type, stop_words=stop_words)
    found = search(index, expression, query_type=query_type, offset=offset, limit=None, stop_words=stop_words)
    yield from found.drop("pagerank", "score").toLocalIterator()


# ---------------------------------------------------------------- result pages


def pagination(terms: str, offset: int, shown: int, total_hits: int, page: int) -> dict:
    """from, to, total, prev and next; the links keep the terms as given."""
    link = lambda o: f"/search?q={terms}" + (f"&offset={o}" if o > 0 else "")
    return {
        "from": offset + 1 if total_hits else 0, "to": offset + shown, "total": total_hits,
        "prev": link(offset - page) if offset > 0 else "", "next": link(offset + page) if offset + shown < total_hits else "",
    }


@dataclass(frozen=True)
class Results:
    rows: DataFrame  # link_id, url, title, summary (highlighted HTML), pagerank
    pages: dict


def presented(found: DataFrame, terms: str, summary_length: int = 256) -> DataFrame:
    """Results with a title to show, and a summary: matched sentences, escaped, terms highlighted."""
    words = text.query_terms(terms)
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    summary = text.highlighted(html.escape(text.match_summary(F.coalesce("content", F.lit("")), words, summary_length)), words)
    return found.select("link_id", "url", title.alias("title"), summary.alias("summary"), "pagerank")


def run_query(docs: DataFrame | Index, terms: str, offset: int = 0, *, page: int = PAGE, summary_length: int = 256) -> Results:
    """What a search page shows: a quoted query is a phrase; summaries are made after the limit."""
    kind, index = "phrase" if text.is_phrase(terms) else "match", _indexed(docs)
    found = search(index, terms, query_type=kind, offset=max(0, offset), limit=page)
    number = total(index, terms, query_type=kind)
    return Results(presented(found, terms, summary_length), pagination(terms, max(0, offset), max(0, min(page, number - offset)), number, page))
