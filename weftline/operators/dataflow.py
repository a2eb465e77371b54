"""Dataflow: stages between a source and a sink.

A stage is a function from DataFrame to DataFrame. Rows flow through narrow plans, task slots are the
workers, and the first failing task fails the run, with its error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..sources.scratch import table

Processor = Callable[[DataFrame], DataFrame]


def fifo(process: Processor) -> Processor:
    """One row in, none or one out, in the order given."""
    return process


def fixed_pool(workers: int, process: Processor) -> Processor:
    """Rows spread over a fixed number of tasks, in no order."""
    if workers <= 0:
        raise ValueError("a pool needs one worker at least")
    return lambda df: process(df.repartition(workers))


def dynamic_pool(most: int, process: Processor) -> Processor:
    """At most so many tasks; fewer where the plan has fewer."""
    if most <= 0:
        raise ValueError("a pool needs one worker at least")
    return lambda df: process(df.coalesce(most))


def broadcast(*processes: Processor) -> Processor:
    """Every row to every processor; their results together. The input is written once, not computed once
    for each."""
    if not processes:
        raise ValueError("a broadcast needs one processor at least")

    def run(df: DataFrame) -> DataFrame:
        shared = table(df, "broadcast")
        return reduce(lambda a, b: a.unionByName(b), [p(shared) for p in processes])

    return run


def discard(df: DataFrame) -> None:
    """A sink that computes all and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Processor, ...]

    @classmethod
    def of(cls, *stages: Processor) -> Pipeline:
        return cls(stages)

    def __call__(self, source: DataFrame) -> DataFrame:
        return reduce(lambda df, stage: df.transform(stage), self.stages, source)

    def process(self, source: DataFrame, sink: Callable[[DataFrame], None] = discard) -> None:
        sink(self(source))


def count_sink(df: DataFrame) -> int:
    """A sink that counts what arrives."""
    return df.count()
