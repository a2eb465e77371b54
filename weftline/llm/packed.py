"""Packed exchanges: blocks of rows send sorted arrays to routes (ranges or hash ranges of a key), a route
sees what all blocks say about its keys at once, and answers each block in the order it was asked in.

A block sums up its own rows first, so a key that very many rows hold is sent once by each block. Arrays go
as byte planes, sorted keys as differences, compressed: a few bytes a key where rows take dozens. A route is
a group of one grouped map, so a task holds one route at a time; the number of routes grows with the input."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "block bigint, route int, data binary"
NOBODY = -1  # the block of rows that are for the driver; no number below 0 is a block


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 (or of 64 unsigned bits) as compressed byte planes."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a).astype(np.uint64, copy=False)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        head += [len(a), width]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() if len(a) else b"")
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays that were packed, as unsigned 64-bit numbers."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * count].view(np.int64).tolist(), 8 + 16 * count, []
    for n, width in zip(head[::2], head[1::2]):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(wide.view(np.uint64).reshape(-1))
        at += n * width
    return out


def signed(a: np.ndarray) -> np.ndarray:
    """Whole numbers of either sign as numbers from 0, small ones small."""
    a = a.astype(np.int64, copy=False)
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def unsigned(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(1)).astype(np.int64) ^ -(a & np.uint64(1)).astype(np.int64)


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned keys, the first being the first key."""
    out = keys.astype(np.uint64)
    out[1:] -= out[:-1].copy()
    return out


def summed(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """(block, route, data) rows as a batch of SENT."""
    kinds = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["block", "route", "data"])


def give_back() -> None:
    """Memory that a worker has freed goes back to the machine: workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def answered(sent: DataFrame, solve: Callable[[int, list[int], list[bytes]], list[tuple[int, bytes]]]) -> DataFrame:
    """What solve(route, blocks, data) answers, as SENT: pairs of a block (or NOBODY) and its answer. It sees
    the blocks in order, whatever order they came in."""

    def run(got: pa.Table) -> pa.Table:
        route = got.column("route")[0].as_py()
        asked = sorted(zip(got.column("block").to_pylist(), got.column("data").to_pylist()))
        out = rows([(block, route, data) for block, data in solve(route, [a[0] for a in asked], [a[1] for a in asked])])
        give_back()
        return pa.Table.from_batches([out])

    return sent.groupBy("route").applyInArrow(run, SENT)


def told(answers: DataFrame) -> Iterator[tuple[int, bytes]]:
    """(route, data) of the answers for the driver: one small row a route."""
    for row in answers.where(F.col("block") == NOBODY).toLocalIterator():
        yield row["route"], bytes(row["data"])


def by_step(answers: pa.Table) -> dict[int, list[bytes]]:
    """A block's answers by step, in order of the routes. answers: step, route, data."""
    out: dict[int, list[bytes]] = {}
    for step, _, data in sorted(zip(*(answers.column(c).to_pylist() for c in ("step", "route", "data")))):
        out.setdefault(step, []).append(data)
    return out


def met(blocks: DataFrame, answers: list[DataFrame], run: Callable[[pa.Table, dict[int, list[bytes]]], pa.Table], schema) -> DataFrame:
    """run(block, its answers by step) for every block (a row with the column `block`)."""
    both = None
    for step, one in enumerate(answers):
        one = one.where(F.col("block") >= 0).withColumn("step", F.lit(step))
        both = one if both is None else both.unionByName(one)

    def joined(block: pa.Table, got: pa.Table) -> pa.Table:
        return run(block, by_step(got))

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(joined, schema)


def route_bits(entries: float, held: int) -> int:
    """Bits of a route number, for routes of about `held` entries; 8 routes at least."""
    return max(3, min(20, (int(entries // held)).bit_length()))
