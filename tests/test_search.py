"""The index contract, ranking, summaries, highlights, pages; dataflow."""

import pytest
from pyspark.sql import functions as F

from weftline.errors import MissingLinkId, NotFound
from weftline.functions import text
from weftline.operators import dataflow, textindex

SCHEMA = "link_id string, url string, title string, content string, indexed_at timestamp_ntz, pagerank double"


def docs(spark, rows):
    return spark.createDataFrame([(i, f"http://{i}", t, c, None, r) for i, t, c, r in rows], SCHEMA)


def test_index_contract(spark):
    index = docs(spark, []).limit(0)
    new = docs(spark, [("a", "T", "one", 9.0)])
    index = textindex.index_docs(index, new, "2024-01-01 00:00:00")
    assert textindex.find_by_id(index, "a").pagerank == 0.0
    index = textindex.update_scores(index, spark.createDataFrame([("a", 0.5), ("x", 0.25)], "link_id string, score double"))
    placeholder = textindex.find_by_id(index, "x")
    assert (placeholder.url, placeholder.title, placeholder.content, placeholder.pagerank) == ("", "", "", 0.25) and placeholder.indexed_at.year == 1
    again = textindex.index_docs(index, docs(spark, [("a", "T2", "two", 0.0)]), "2024-01-02 00:00:00")
    row = textindex.find_by_id(again, "a")
    assert (row.title, row.content, row.pagerank, str(row.indexed_at)) == ("T2", "two", 0.5, "2024-01-02 00:00:00")
    with pytest.raises(NotFound):
        textindex.find_by_id(again, "none")
    for bad in (None, ""):
        with pytest.raises(MissingLinkId):
            textindex.index_docs(again, docs(spark, [(bad, "", "", 0.0)]) if bad == "" else spark.createDataFrame([(None, "", "", "", None, 0.0)], SCHEMA))


def test_phrase_and_match(spark):
    rows = [(f"{k:02}", "Test-7" if k == 3 else None, "Lorem Dolor Ipsum poeta" if k % 2 else "lorem ipsum dolor poeta", 1 - k / 100) for k in range(50)]
    index = docs(spark, rows)
    assert {r.link_id for r in textindex.phrase(index, '"lorem dolor ipsum"').collect()} == {f"{k:02}" for k in range(1, 50, 2)}
    assert textindex.total(index, "lorem ipsum") == 50 and textindex.total(index, "the") == 0 and textindex.total(index, "") == 0
    assert [r.link_id for r in textindex.match(index, "Test").collect()] == ["03"]
    ordered = [r.link_id for r in textindex.search(index, "poeta", limit=None).collect()]
    assert ordered == sorted(ordered)
    pages = [r.link_id for o in range(0, 60, 10) for r in textindex.search(index, "poeta", offset=o).collect()]
    assert pages == ordered and textindex.search(index, "poeta", offset=200).count() == 0
    moved = textindex.update_scores(index, spark.createDataFrame([("49", 5.0)], "link_id string, score double"))
    assert textindex.search(moved, "poeta").first().link_id == "49"
    assert textindex.search(index, "dolor", query_type="other").count() == 10
    with pytest.raises(ValueError):
        textindex.search(index, "x", offset=-1)


def test_additive_ranking_and_empty_index(spark):
    index = docs(spark, [("a", "", "rare word", 0.0), ("b", "", "word word word", 0.9), ("c", "", "other", 1.0)])
    scores = {r.link_id: r.score for r in textindex.bm25(index, "rare word").collect()}
    got = textindex.search(index, "rare word", ranking="additive").collect()
    assert [r.link_id for r in got] == sorted(scores, key=lambda k: -scores[k] * (scores[k] + {"a": 0.0, "b": 0.9}[k]))
    assert textindex.search(index.limit(0), "word").count() == 0


def test_stored_index(spark, tmp_path):
    """Queries read the postings of their terms, not the texts; phrases follow places within one field."""
    rows = docs(spark, [("a", "Red wool", "blue wool and red silk", 0.5), ("b", "wool red", "silk", 0.1), ("c", None, "red red wool red wool", 0.2), ("d", "red", "wool", 0.9)])
    index = textindex.Index.build(rows, f"{tmp_path}/index")
    for one in (index, textindex.Index.open(rows, f"{tmp_path}/index")):
        assert {r.link_id for r in textindex.phrase(one, "red wool").collect()} == {"a", "c"}
        assert {r.link_id for r in textindex.phrase(one, "red wool red wool").collect()} == {"c"} and textindex.phrase(one, "").count() == 0
        assert textindex.total(one, "silk") == 2 and textindex.total(one, "the") == 0 and (one.number, one.mean) == (4, 17 / 4)
        assert [r.link_id for r in textindex.search(one, "red", ranking="pagerank_first").collect()] == ["d", "a", "c", "b"]
    plan = index.docs.sparkSession._jvm.PythonSQLUtils.explainString(textindex.search(index, "red wool")._jdf.queryExecution(), "formatted")
    assert "regexp" not in plan and "In(term, [red,wool])" in plan
    got = list(textindex.streamed(index, "wool", offset=1))
    assert got[0] == 4 and [r.link_id for r in got[1:]] == ["a", "c", "b"] and "pagerank" not in got[1].asDict()


def test_documents_for_other_systems(spark):
    rows = spark.sql("select 'ab' link_id, 'u' url, 't' title, 'c' content, timestamp_ntz'2024-01-02 03:04:05.678901' indexed_at, 0.5d pagerank")
    out = textindex.external(rows)
    assert out.first().IndexedAt == "2024-01-02T03:04:05.678901Z" and textindex.from_external(out).collect() == rows.collect()
    assert textindex.index_subset(rows).columns == ["link_id", "title", "content", "pagerank"]


def test_postings(spark):
    got = textindex.postings(docs(spark, [("a", "One two", "two Three", 0.0), ("b", None, None, 0.0)])).collect()
    assert {(r.field, r.term, r.pos) for r in got} == {("title", "one", 0), ("title", "two", 1), ("content", "two", 0), ("content", "three", 1)}


def shown(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_index_is_built_where_documents_are_read(spark, tmp_path):
    """F6, F7, F8, F11: no shuffle of tokens; each file in order of its terms, places by field."""
    rows = docs(spark, [("a", "Red wool", "blue wool and wool", 0.5), ("b", None, "", 0.1), ("c", "", None, 0.1)])
    index = textindex.Index.build(rows.repartition(3), f"{tmp_path}/index")
    assert sorted((r.term, r.link_id, r.title, r.content, r.tf, r.len) for r in index.terms.collect()) == [
        ("and", "a", [], [2], 1, 6), ("blue", "a", [], [0], 1, 6), ("red", "a", [0], [], 1, 6), ("wool", "a", [1], [1, 3], 3, 6),
    ]
    assert (index.number, index.mean) == (3, 2.0)
    found = rows.select(F.explode(textindex.gathered(text.tokens(F.col("title")), text.tokens(F.col("content")))).alias("t"))
    assert "Exchange" not in shown(found) and textindex.Index.build(rows.limit(0), f"{tmp_path}/none").mean == 0.0


def test_frequencies(spark):
    """partial sums are shuffled, by term alone; rows that share an id are one document."""
    rows = docs(spark, [("a", "One two", "two Three", 0.0), ("b", None, None, 0.0), ("c", "", "three three", 0.0)])
    got = lambda df: sorted((r.term, r.df, r.cf) for r in textindex.frequencies(df).collect())
    assert got(rows) == [("one", 1, 1), ("three", 2, 3), ("two", 1, 2)]
    assert shown(textindex.frequencies(rows)).count("hashpartitioning(") == 1
    assert got(rows.unionByName(docs(spark, [("a", "two", "four", 0.0)]))) == [("four", 1, 1), ("one", 1, 1), ("three", 2, 3), ("two", 1, 3)]


@pytest.mark.parametrize("value, cut", [
    ("It rains.Then snow falls ! Prices in +euro+.7 pm is late at 7. Really?", ["It rains.", "Then snow falls !", " Prices in +euro+.", "7 pm is late at 7.", " Really?"]),
    ("A trip to the E.U. Later on. v3.4 now", ["A trip to the E.U. Later on.", " v3.", "4 now"]), ("What?! No. so", ["What?", "! No.", " so"]), ("nothing to cut", ["nothing to cut"]), ("y", ["y"]), ("", []),
])
def test_sentences(spark, value, cut):
    assert spark.createDataFrame([(value,)], "t string").select(text.sentences(F.col("t"))).first()[0] == cut


def test_summary_and_highlight(spark):
    # shares: 2 of 4 words, 1 of 3, 1 of 16; 60 bytes hold the first two whole and 13 of the third
    wool, far, last = "Red wool and wool.", " We like wool !", " Knitting takes time but who has wool and patience may make a scarf in one week"
    long = f"{wool} Nothing of it here.{far}{last}"
    df = spark.createDataFrame([(long, "Alpha one. Beta two. Gamma one.")], "a string, b string")
    row = df.select(text.match_summary(F.col("a"), text.query_terms('"wool we"'), 46), text.match_summary(F.col("b"), ["one"]), text.match_summary(F.col("a"), []), text.match_summary(F.col("a"), ["wool"], 500)).first()
    assert row[0] == f"{wool}..{far}.{last[:13]}...", row[0]
    assert row[1] == "" and row[2] == "" and row[3] == f"{wool}..{far}.{last}."
    marks = spark.createDataFrame([("Try wool",), ("End. SILK and cotton.wool",), ("no thread",), ("a+b A+B",)], "t string").select(text.highlighted(F.col("t"), ["wool", "silk", "a+b"])).collect()
    assert [m[0] for m in marks] == ["Try <em>wool</em>", "End. <em>SILK</em> and cotton.<em>wool</em>", "no thread", "<em>a+b</em> <em>A+B</em>"]


@pytest.mark.parametrize("offset, expected", [
    (0, (1, 2, "", "/search?q=KEYWORD&offset=2")), (2, (3, 4, "/search?q=KEYWORD", "/search?q=KEYWORD&offset=4")),
    (4, (5, 6, "/search?q=KEYWORD&offset=2", "/search?q=KEYWORD&offset=6")), (8, (9, 10, "/search?q=KEYWORD&offset=6", "")),
])
def test_pagination(offset, expected):
    page = textindex.pagination("KEYWORD", offset, 2, 10, 2)
    assert (page["from"], page["to"], page["prev"], page["next"]) == expected and page["total"] == 10


def test_run_query(spark):
    index = docs(spark, [("a", "", "First <b> cats run. Nothing here.", 0.1), ("b", "Title", "dogs and cats run", 0.9)])
    got = textindex.run_query(index, "cats")
    rows = got.rows.collect()
    assert [(r.link_id, r.title) for r in rows] == [("b", "Title"), ("a", "http://a")]
    assert rows[1].summary == "First &lt;b&gt; <em>cats</em> run." and got.pages["total"] == 2
    assert textindex.run_query(index, '"dogs and cats"').pages["total"] == 1 and textindex.run_query(index, "none").pages["from"] == 0


def test_dataflow(spark):
    source = spark.range(10)
    flow = dataflow.Pipeline.of(dataflow.fifo(lambda d: d.where("id > 3")), dataflow.fixed_pool(3, lambda d: d), dataflow.dynamic_pool(2, lambda d: d), dataflow.broadcast(lambda d: d, lambda d: d.withColumn("id", -F.col("id"))))
    assert sorted(r.id for r in flow(source).collect()) == [-9, -8, -7, -6, -5, -4, 4, 5, 6, 7, 8, 9]
    assert dataflow.count_sink(flow(source)) == 12
    flow.process(source)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        dataflow.Pipeline.of(lambda d: d.select(F.expr("1 / (id - 5)"))).process(source)
    for bad in (lambda: dataflow.fixed_pool(0, None), lambda: dataflow.dynamic_pool(0, None), lambda: dataflow.broadcast()):
        with pytest.raises(ValueError):
            bad()
