"""Vertex programs and PageRank."""

import pytest
from pyspark.sql import functions as F

from weftline.errors import InvalidDestination, UnknownEdgeSource
from weftline.operators import bsp
from weftline.operators.pagerank import Config, dead_ends, out_degrees, pagerank

GOLDEN = [
    ("ring", "A B C", "AB BC CA", {"A": 1 / 3, "B": 1 / 3, "C": 1 / 3}, 2),
    ("back link", "A B C", "AB BC CA CB", {"A": 0.214862, "B": 0.397227, "C": 0.387911}, 14),
    ("chain", "A B C", "AB BA BC CB", {"A": 0.256659, "B": 0.486682, "C": 0.256659}, 42),
    ("dead end", "A B C", "AB BC", {"A": 0.184443, "B": 0.341096, "C": 0.474462}, 12),
    ("two", "A B", "AB BA", {"A": 0.5, "B": 0.5}, 2),
    ("parallel", "A B C", "AB AB AC BA CA", {"A": 0.486682, "B": 0.325545, "C": 0.187773}, None),
    ("loops", "A B C", "AA AB BA CC", {"A": 0.465048, "B": 0.465048, "C": 0.069904}, None),
    ("dangling", "A B", "AB BA AX XA", {"A": 0.5, "B": 0.5}, 2),
]


def frames(spark, vertices, edges):
    return spark.createDataFrame([(v,) for v in vertices.split()], "id string"), spark.createDataFrame([tuple(e) for e in edges.split()] or [], "src string, dst string")


@pytest.mark.parametrize("name, vertices, edges, expected, last", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(spark, name, vertices, edges, expected, last):
    done = pagerank(*frames(spark, vertices, edges))
    got = {r.id: r["rank"] for r in done.scores.collect()}
    assert got == pytest.approx(expected, abs=1e-5) and sum(got.values()) == pytest.approx(1, abs=1e-3)
    assert last is None or done.superstep == last


def test_hubs(spark, monkeypatch):
    """Vertices of many edges give the same ranks, wherever their edges lie."""
    from weftline.operators import pagerank as module

    v, e = frames(spark, "A B C D E", "AB AC AD AE BA CA DA EA EB")
    plain = {r.id: r["rank"] for r in pagerank(v, e).scores.collect()}
    monkeypatch.setattr(module, "HUB", 2)
    assert {r.id: r["rank"] for r in pagerank(v, e).scores.collect()} == pytest.approx(plain, abs=1e-12)
    monkeypatch.setattr(module, "HUB", 1)
    assert {r.id: r["rank"] for r in pagerank(v, e).scores.collect()} == pytest.approx(plain, abs=1e-12)


def test_edges_are_numbers_sorted_once(spark, monkeypatch):
    """supersteps see no names, and read edges that lie sorted by source."""
    from weftline.operators import pagerank as module

    v, e = frames(spark, "A B C", "AB BC CB")
    plain, plans = {r.id: r["rank"] for r in pagerank(v, e, steps=4).scores.collect()}, []
    table = module.table

    def seen(df, name):
        if name == "ranks":
            plans.append((set(df.schema.simpleString().split("string")), spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")))
        return table(df, name)

    monkeypatch.setattr(module, "table", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.id: r["rank"] for r in pagerank(v, e, steps=4).scores.collect()} == pytest.approx(plain, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 2 and all(len(pieces) == 1 for pieces, _ in plans)
    for _, plan in plans[1:]:
        own, cached = plan.split("InMemoryRelation", 1)
        assert "Sort [s#" not in own and "Sort [s#" in cached


def test_steps_and_limits(spark):
    v, e = frames(spark, "A B C", "AB BC")
    assert {r["rank"] for r in pagerank(v, e, steps=1).scores.collect()} == {0.0}
    assert {r["rank"] for r in pagerank(v, e, steps=2).scores.collect()} == {1 / 3}
    assert pagerank(v.limit(0), e).scores.count() == 0
    with pytest.raises(InvalidDestination):
        pagerank(v, frames(spark, "A", "AX")[1], strict=True)
    for bad in ({"damping": 0}, {"damping": 1.5}, {"tolerance": 0}, {"tolerance": 1}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_degrees(spark):
    v, e = frames(spark, "A B C", "AB AB AA BC")
    assert {(r.src, r.degree) for r in out_degrees(e).collect()} == {("A", 2), ("B", 1)}
    assert [r.id for r in dead_ends(v, e).collect()] == ["C"]


def graph(spark, values, edges):
    vertices = spark.createDataFrame([(k, float(x)) for k, x in values.items()], "id string, value double")
    return bsp.Graph.of(vertices, spark.createDataFrame([tuple(e) for e in edges.split()], "src string, dst string"))


def test_exchange(spark):
    """Two vertices swap their values in two steps."""
    program = bsp.Program(update=lambda s: F.coalesce("msg", "value"), payload=lambda s: F.col("value") if s.number == 0 else F.lit(None).cast("double"))
    done = bsp.execute(graph(spark, {"0": 1, "1": 42}, "01 10"), program, steps=2)
    assert {r.id: r.value for r in done.vertices.collect()} == {"0": 42, "1": 1}


def test_aggregators_seeded_and_callbacks(spark):
    seen = []
    program = bsp.Program(update=lambda s: F.col("value") + 1, aggregators={"n": F.count(F.lit(1))})
    vertices = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(0.0).alias("value"))
    total = bsp.Accumulator(5)
    done = bsp.execute(bsp.Graph.of(vertices, spark.createDataFrame([], "src string, dst string")), program, steps=1, pre_step=lambda s: seen.append(("pre", s.number)), post_step=lambda s, ran: seen.append(("post", ran)))
    total.aggregate(done.values["n"])
    assert total.get() == 1005 and total.delta() == 1000 and total.delta() == 0 and seen == [("pre", 0), ("post", 1000)]


def test_freeze_and_wake(spark):
    """A sleeping vertex runs only when a message comes; the run ends when none runs."""
    program = bsp.Program(
        update=lambda s: F.col("value") + F.coalesce("msg", F.lit(0.0)),
        payload=lambda s: F.when(F.col("src") == "a", F.lit(7.0)) if s.number == 0 else F.lit(None).cast("double"), halt=lambda s: F.lit(True),
    )
    done = bsp.execute(graph(spark, {"a": 0, "b": 0, "c": 0}, "ab bc"), program)
    assert {r.id: (r.value, r.active) for r in done.vertices.collect()} == {"a": (0, False), "b": (7, False), "c": (0, False)}
    assert done.superstep == 2
    kept = bsp.execute(graph(spark, {"a": 0}, "aa"), bsp.Program(update=lambda s: F.col("value") + 1), keep_running=lambda s, ran: s.number < 3)
    assert kept.vertices.first().value == 4 and kept.superstep == 3


def test_unknown_vertices(spark):
    send = bsp.Program(update=lambda s: F.col("value"), payload=lambda s: F.lit(1.0))
    with pytest.raises(InvalidDestination):
        bsp.execute(graph(spark, {"a": 0}, "ax"), send, steps=1, strict=True)
    assert bsp.execute(graph(spark, {"a": 0}, "ax"), send, steps=2).vertices.count() == 1
    g = graph(spark, {"a": 0}, "aa")
    more = spark.createDataFrame([("x", "a")], "src string, dst string")
    with pytest.raises(UnknownEdgeSource):
        g.add_edges(more)
    assert g.add_edges(more, strict=False).edges.count() == 1
    new = g.add_vertices(spark.createDataFrame([("a", 3.0), ("b", 4.0)], "id string, value double"))
    assert {r.id: (r.value, r.active) for r in new.vertices.collect()} == {"a": (3, True), "b": (4, True)}


def test_messages_to_any_vertex(spark):
    """Vertices without edges send to whom they like; messages may be lists."""
    vertices = spark.createDataFrame([("a", "-"), ("b", "-"), ("c", "-")], "id string, value string")
    none = spark.createDataFrame([], "src string, dst string")
    to_all = lambda s: F.array(*[F.struct(F.lit(t).alias("to"), F.concat("id", F.lit(">"), F.lit(t)).alias("payload")) for t in "ab"]) if s.number == 0 else F.expr("cast(array() as array<struct<to:string,payload:string>>)")
    program = bsp.Program(update=lambda s: F.coalesce(F.array_join(F.array_sort("msg"), " "), F.col("value")), send=to_all, merge=lambda: F.collect_list("payload"), message="array<string>")
    done = bsp.execute(bsp.Graph.of(vertices, none), program, steps=2)
    assert {r.id: r.value for r in done.vertices.collect()} == {"a": "a>a b>a c>a", "b": "a>b b>b c>b", "c": "-"}


def test_edge_values(spark):
    """A program sets its out-edges, and sends along them what they hold."""
    program = bsp.Program(
        update=lambda s: F.col("value") + F.coalesce("msg", F.lit(0.0)), payload=lambda s: F.col("edge_value"),
        edges=lambda s: F.when(F.col("src") == "a", F.coalesce("edge_value", F.lit(0.0)) + 1).otherwise(F.col("edge_value")),
    )
    g = graph(spark, {"a": 0, "b": 0}, "ab ba")
    done = bsp.execute(g, program, steps=4)
    assert {(r.src, r.value) for r in done.edges.collect()} == {("a", 4.0), ("b", None)}
    assert {r.id: r.value for r in done.vertices.collect()} == {"a": 0, "b": 1 + 2}  # an edge value goes along in the step behind the one that sets it


def test_relay_between_two_graphs(spark):
    """A message to a vertex of another graph is handed over, and its answer comes back."""
    outbox = []
    relay = bsp.Settings(relay=lambda unknown: outbox.append([(r["to"], r.msg) for r in unknown.collect()]))
    forward = lambda to: bsp.Program(
        update=lambda s: F.col("value") + F.coalesce("msg", F.lit(0.0)), halt=lambda s: F.lit(True),
        send=lambda s: F.when(F.col("value") > 0, F.array(F.struct(F.lit(to).alias("to"), F.col("value").alias("payload")))),
    )
    one, two = bsp.Execution(graph(spark, {"a": 42}, "aa"), forward("b"), relay), bsp.Execution(graph(spark, {"b": 0}, "bb"), forward("a"), relay)
    two.step()
    assert outbox == [[]] or outbox == []
    outbox.clear()
    one.step()
    assert outbox == [[("b", 42.0)]]
    two.take_messages()
    two.deliver(spark.createDataFrame(outbox.pop(), "to string, payload double"))
    assert two.step() == 1 and two.vertices.first().value == 42 and outbox == [[("a", 42.0)]]
    one.take_messages()
    one.deliver(spark.createDataFrame(outbox.pop(), "to string, payload double"))
    one.step()
    assert one.vertices.first().value == 84
    with pytest.raises(ValueError):
        bsp.Settings(strict=True, relay=print)
    with pytest.raises(ValueError):
        bsp.Settings(most_steps=0)


def test_reset_and_close(spark):
    counting = bsp.Program(update=lambda s: F.col("value") + 1)
    with bsp.Execution(graph(spark, {"a": 0}, "aa"), counting, bsp.Settings(most_steps=3)) as run:
        assert run.run(2).vertices.first().value == 2 and run.run(2).vertices.first().value == 4 and run.number == 4
        run.reset()
        assert run.number == 0 and run.run().vertices.first().value == 3
        held = list(run._written)
    from weftline.sources.scratch import _written

    assert len(held) == 1 and run._written == [] and held[0]._scratch_path not in _written


def test_nothing_that_grows_is_broadcast(spark, monkeypatch, tmp_path):
    """scratch tables are small as files; their rows do not go through the driver for that."""
    from weftline.operators import linkgraph, pagerank as module
    from weftline.plans import queries

    plans, write = [], module.table

    def told(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(module, "table", told)
    monkeypatch.setattr(linkgraph, "table", told)
    page = F.concat(F.lit("http://a.example/"), F.col("id").cast("string")).alias("url")
    html = F.concat(F.lit('<title>t</title><a href="/'), F.pmod(F.col("id") * 7 + 1, F.lit(50)).cast("string"), F.lit('">x</a>'))
    spark.range(50).select(F.col("id").alias("page_id"), page, html.alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    best = queries.flagship(spark, str(tmp_path))
    plans.append(best._jdf.queryExecution().executedPlan().toString())
    assert best.count() == 10 and len(plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
