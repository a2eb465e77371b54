"""Vertex programs in supersteps, as DataFrames.

A program says with Columns what a vertex does; one superstep is a left join of the merged messages to
the vertices, and one grouped aggregate of new messages by destination. Values are written as a scratch
table after each superstep, which is the barrier: plans stay short, a lost executor costs one step, and
all aggregators of the step come from one pass over that table. The table of the step before goes then."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidDestination, UnknownEdgeSource
from ..sources.scratch import drop, sorted_join, table


class Accumulator:
    """A running sum on the driver: get, set, add, and delta since the last delta or set."""

    def __init__(self, value: float = 0):
        self.set(value)

    def set(self, value: float) -> None:
        self._value = self._seen = value

    def get(self) -> float:
        return self._value

    def aggregate(self, amount: float) -> None:
        self._value += amount

    def delta(self) -> float:
        change, self._seen = self._value - self._seen, self._value
        return change


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame  # id, value, active
    edges: DataFrame  # src, dst, value

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        """From (id, value) and (src, dst[, value]); all vertices active."""
        with_value = edges if "value" in edges.columns else edges.withColumn("value", F.lit(None).cast("double"))
        return cls(vertices.select("id", "value", F.lit(True).alias("active")), with_value.select("src", "dst", "value"))

    def add_vertices(self, incoming: DataFrame) -> Graph:
        """`incoming`: id, value. New ids come in active; known ones take the value and keep the rest."""
        both = self.vertices.withColumnsRenamed({"value": "old", "active": "was"}).join(incoming.select("id", "value", F.lit(True).alias("given")), "id", "full_outer")
        value = F.when(F.col("given"), F.col("value")).otherwise(F.col("old"))
        return replace(self, vertices=both.select("id", value.alias("value"), F.coalesce("was", F.lit(True)).alias("active")))

    def add_edges(self, incoming: DataFrame, *, strict: bool = True) -> Graph:
        """`incoming`: src, dst[, value]. Sources must exist; destinations are not looked at, and parallel
        edges stay. Unknown sources raise UnknownEdgeSource, or drop their edge when not strict."""
        new = incoming if "value" in incoming.columns else incoming.withColumn("value", F.lit(None).cast("double"))
        ids = self.vertices.select(F.col("id").alias("known"))
        if strict and new.join(ids, F.col("src") == F.col("known"), "left_anti").take(1):
            raise UnknownEdgeSource("an edge leaves a vertex that is not there")
        kept = new.join(ids, F.col("src") == F.col("known"), "left_semi")
        return replace(self, edges=self.edges.unionByName(kept.select("src", "dst", "value")))


@dataclass(frozen=True)
class Step:
    """What a program sees: the superstep's number and the aggregators' values of the step before."""

    number: int
    values: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Program:
    """Columns over id, value, msg (merged messages, null without any).

    update: the new value. payload: what goes along each out-edge (over src, value, edge_value, dst;
    null sends nothing); None sends nothing at all. send: messages to any vertices, an array of structs
    (to, payload) over id and the new value. edges: the new value of the out-edges of vertices that ran, over
    the same columns as payload. merge: aggregate over `payload`; `message` is its type, so that messages may
    be sums, structs or lists (collect_list, in no order). halt: whether the vertex goes to sleep until a
    message comes. aggregators: aggregates over id, value, old, msg of the vertices that ran."""

    update: Callable[[Step], Column]
    payload: Callable[[Step], Column] | None = None
    send: Callable[[Step], Column] | None = None
    edges: Callable[[Step], Column] | None = None
    merge: Callable[[], Column] = lambda: F.sum("payload")
    message: str = "double"
    halt: Callable[[Step], Column] = lambda step: F.lit(False)
    aggregators: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    """strict: messages to unknown vertices raise InvalidDestination. relay: takes them instead, as a frame (to,
    msg), before the next superstep. most_steps: a run without a limit of its own ends there."""

    strict: bool = False
    relay: Callable[[DataFrame], None] | None = None
    most_steps: int | None = None

    def __post_init__(self) -> None:
        if self.strict and self.relay is not None:
            raise ValueError("messages to unknown vertices are either an error or relayed")
        if self.most_steps is not None and self.most_steps < 1:
            raise ValueError("a run has one superstep at least")


@dataclass
class Run:
    vertices: DataFrame
    superstep: int
    values: dict[str, float]
    active: int
    edges: DataFrame | None = None


class Execution:
    """A graph and a program under way: supersteps one by one, or until nothing runs. Values, edges, messages and
    aggregators are kept between calls; reset() goes back to the start, close() removes what was written."""

    def __init__(self, graph: Graph, program: Program, settings: Settings = Settings()):
        self.graph, self.program, self.settings, self._written = graph, program, settings, []
        self.reset()

    def reset(self) -> None:
        self.close()
        self.vertices, self.edges, self.messages, self.values, self.number, self.ran = self.graph.vertices, self.graph.edges, None, {}, 0, 0

    def close(self) -> None:
        drop(*self._written)
        self._written = []

    def __enter__(self) -> Execution:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def deliver(self, incoming: DataFrame) -> None:
        """Messages (to, payload) from elsewhere, for the next superstep; with those that wait already."""
        merged = incoming.groupBy("to").agg(self.program.merge().cast(self.program.message).alias("msg"))
        if self.messages is not None:
            raise ValueError("messages are delivered before the first superstep or after take_messages()")
        self.messages = merged

    def take_messages(self) -> DataFrame | None:
        """The messages (to, msg) that wait for the next superstep; they wait no longer."""
        waiting, self.messages = self.messages, None
        return None if waiting is None else table(waiting, "messages")

    def step(self) -> int:
        """One superstep; returns how many vertices ran."""
        program, step = self.program, Step(self.number, dict(self.values))
        vertices, messages = self.vertices, self.messages
        seen = vertices.withColumn("msg", F.lit(None).cast(program.message)) if messages is None else vertices.join(sorted_join(messages), vertices["id"] == messages["to"], "left").drop("to")
        runs = F.col("active") | F.col("msg").isNotNull()
        kind = self.graph.vertices.schema["value"].dataType
        after = table(seen.select(
            "id", F.when(runs, program.update(step)).otherwise(F.col("value")).cast(kind).alias("value"), F.col("value").alias("old"),
            F.when(runs, ~program.halt(step)).otherwise(F.col("active")).alias("active"), "msg", runs.alias("ran"),
        ), "superstep")
        took_part = after.where("ran")
        row = took_part.agg(F.count(F.lit(1)).alias("__ran"), *[a.alias(n) for n, a in program.aggregators.items()]).first().asDict()
        self.ran = row.pop("__ran")
        self.values = {k: 0 if v is None else v for k, v in row.items()}
        self.vertices, self.messages, before, self._written = after.select("id", "value", "active"), None, self._written, [after]
        along = lambda: took_part.select(F.col("id").alias("src"), "value").join(sorted_join(self.edges.withColumnRenamed("value", "edge_value")), "src")
        sent = []
        if program.payload:
            sent.append(along().select(F.col("dst").alias("to"), program.payload(step).alias("payload")))
        if program.send:
            sent.append(took_part.select(F.explode(program.send(step)).alias("m")).select("m.to", "m.payload"))
        if sent:
            self.messages = self._addressed(reduce(DataFrame.unionByName, sent).where(F.col("payload").isNotNull()))
        if program.edges:
            if self.messages is not None and not any(self.messages is w for w in self._written):  # they read the edges as they were
                self.messages = table(self.messages, "messages")
                self._written.append(self.messages)
            changed = along().select("src", "dst", program.edges(step).alias("value"))
            rest = self.edges.join(sorted_join(took_part.select(F.col("id").alias("src"))), "src", "left_anti")
            self.edges = table(rest.unionByName(changed.select("src", "dst", F.col("value").cast(self.edges.schema["value"].dataType).alias("value"))), "edges")
            self._written.append(self.edges)
        else:
            self._written += [w for w in before if w is self.edges]
        drop(*[w for w in before if not any(w is x for x in self._written)])
        self.number += 1
        return self.ran

    def _addressed(self, sent: DataFrame) -> DataFrame:
        """Merged messages; those to unknown vertices raise or are relayed, else the next join drops them."""
        merged = sent.groupBy("to").agg(self.program.merge().cast(self.program.message).alias("msg"))
        if not self.settings.strict and self.settings.relay is None:
            return merged
        merged = table(merged, "messages")
        self._written.append(merged)
        unknown = merged.join(sorted_join(self.vertices.select("id")), F.col("to") == F.col("id"), "left_anti")
        if self.settings.strict and unknown.take(1):
            raise InvalidDestination("a message goes to a vertex that is not there")
        if self.settings.relay is not None:
            self.settings.relay(unknown)
        return merged

    def run(
        self, steps: int | None = None, *, pre_step: Callable[[Step], None] | None = None, post_step: Callable[[Step, int], None] | None = None,
        keep_running: Callable[[Step, int], bool] | None = None,
    ) -> Run:
        """`steps` supersteps, or until keep_running says no (it is asked after each one). Without either limit the
        run ends when no vertex ran."""
        first, limit = self.number, steps if steps is not None else self.settings.most_steps
        while limit is None or self.number - first < limit:
            if pre_step:
                pre_step(Step(self.number, dict(self.values)))
            ran = self.step()
            done = Step(self.number - 1, dict(self.values))
            if post_step:
                post_step(done, ran)
            if (keep_running and not keep_running(done, ran)) or (steps is None and not keep_running and not ran):
                return Run(self.vertices, done.number, self.values, ran, self.edges)
        return Run(self.vertices, self.number, self.values, self.ran, self.edges)


def execute(graph: Graph, program: Program, *, steps: int | None = None, strict: bool = False, **callbacks) -> Run:
    """A run from the start: see Execution.run(). Only vertices that are active or have messages run."""
    return Execution(graph, program, Settings(strict=strict)).run(steps, **callbacks)
