"""Benchmark decontamination: CGK embeddings, bit-sampling hashes over windows, exact edit verification.

Texts are sequences of words (A-Z lower-cased, ASCII punctuation left out). The CGK walk reads a window
from its start: in step j it puts out the current word and moves on by one or stays, as a random
function of j and the word says. Windows at edit distance e come out with Hamming distance of the
order of e squared at most, so a hash of a few sampled outputs is equal for similar windows with good
chance, and `repetitions` of it, with other walks and samples, reach `recall`.

Windows are as long as an item allows: the walk's length is the largest of 4, 8, 16 and 32 steps that
leaves room for the stride, which is half the length. Documents are read at every stride-th word, and
items at every word, so any place of an item in a text meets an aligned window. A hit is verified
with the bit-parallel edit distance between the whole item and the text around: it counts if at most
a fifth of the item's words differ.

Items are the stated query set; they go to the tasks in blocks of at most `block_words` words, with a
pass over the documents for each block. Items with fewer than `least_words` words (5) have no room for a
differing word: they are found exactly, by hashes of as many words in a row. Texts are never moved, and a
document is judged whole, wherever it lies.

Defined results: null counts as the empty text, which has no leak; null and repeated ids are kept as
they are; equal rows give equal rows; a null item counts as empty; items without words are found nowhere; no items or
no documents give an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, mix, utf8, words_of

DROP = string.punctuation.encode()
STEPS = (32, 16, 8, 4)
FILTER_BITS = 20
PAIR_BITS = 22


@dataclass(frozen=True)
class Settings:
    share: float = 0.2  # of an item's words that may differ
    recall: float = 0.95
    agree: float = 0.78  # chance that one output agrees for a passage within that share
    samples: int = 5
    overlap: int = 2  # windows over each word of a document
    least_words: int = 5
    block_words: int = 1 << 18
    seed: int = 77

    @property
    def repetitions(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.agree**self.samples))


def steps_for(words: int, s: Settings) -> tuple[int, int]:
    """(steps, stride) of an item."""
    for steps in STEPS:
        stride = max(1, steps // s.overlap) if steps >= 8 else 1
        if steps + stride - 1 <= words:
            return steps, stride
    return words, 1


def walk(words: np.ndarray, starts: np.ndarray, wanted: list[int], repetition: int, s: Settings) -> dict[int, np.ndarray]:
    """One hash for each start and each length in `wanted`, from a walk as long as the longest."""
    rng = np.random.default_rng([s.seed, repetition])
    odd = rng.integers(0, 1 << 63, max(STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    samples = {n: set(rng.choice(n, min(n, s.samples), replace=False).tolist()) for n in STEPS}
    padded = np.concatenate([words, np.zeros(max(STEPS) + 1, np.uint64)])
    at, out = starts.astype(np.int64), {n: np.zeros(len(starts), np.uint64) for n in wanted}
    for j in range(max(wanted)):
        word = padded[at]
        for n in wanted:
            if j in samples[n]:
                out[n] = out[n] * np.uint64(0x9E3779B97F4A7C15) + word
        at = at + ((word * odd[j]) >> np.uint64(63)).astype(np.int64)
    return {n: mix(h, repetition * 64 + n) for n, h in out.items()}


def edits(item: dict, size: int, text: list[int]) -> int:
    """Least edit distance between an item and any part of the text. item: word -> bits of its places."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best = size
    for word in text:
        equal = item.get(word, 0)
        x = equal | minus
        h = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(h | plus) & full)
        down = plus & h
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(x | up) & full)
        minus = up & x
        best = min(best, score)
    return best


def _pair(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    odd = np.uint64(0xD6E8FEB86659FD93)
    return ((words + item.astype(np.uint64) * odd) * odd >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _joined(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out = mix(out + words[j : j + len(out)], j + 1)
    return out


class Items:
    """A block of items, hashed for search."""

    def __init__(self, ids: list, texts: list[bytes], s: Settings):
        self.s = s
        words, at = words_of(texts, DROP)
        self.ids, self.words = [], []
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b > a:
                self.ids.append(ids[k])
                self.words.append(words[a:b])
        self.size = [len(w) for w in self.words]
        self.bits = []
        for w in self.words:
            places: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                places[x] = places.get(x, 0) | 1 << i
            self.bits.append(places)
        groups: dict[tuple[int, int], list] = {}
        begin = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: hash to items
        for k, n in enumerate(self.size):
            if n < s.least_words:
                self.short.setdefault(n, {}).setdefault(int(_joined(self.words[k], n)[0]), []).append(k)
                continue
            steps, stride = steps_for(n, s)
            groups.setdefault((steps, stride), []).extend((k, o) for o in range(n - steps + 1))
        joined = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.known = np.zeros(1 << PAIR_BITS, bool)
        self.known[_pair(joined, np.repeat(np.arange(len(self.size)), self.size))] = True
        self.strides: dict[int, list[int]] = {}
        self.tables: dict[tuple[int, int], tuple] = {}
        for (steps, stride), places in groups.items():
            self.strides.setdefault(stride, []).append(steps)
            item, offset = np.array([p[0] for p in places]), np.array([p[1] for p in places])
            for r in range(s.repetitions):
                key = walk(joined, begin[item] + offset, [steps], r, s)[steps]
                order = np.argsort(key, kind="stable")
                present = np.zeros(1 << FILTER_BITS, bool)
                present[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
                self.tables[steps, r] = (key[order], item[order], offset[order], present)

    def candidates(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item number, place in `words` where the item would begin, text that holds the window's start) of all
        hits, with repeats."""
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
        apart = np.zeros(len(words) + len(at), np.uint64)  # a walk stays on the 0 behind its text, whatever text comes next
        apart[np.arange(len(words)) + text] = words
        for stride, lengths in self.strides.items():
            starts = np.flatnonzero(place % stride == 0)
            for r in range(self.s.repetitions):
                for steps, key in walk(apart, starts + text[starts], lengths, r, self.s).items():
                    keys, item, offset, present = self.tables[steps, r]
                    maybe = np.flatnonzero(present[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    low, high = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
                    number = high - low
                    own = np.repeat(np.arange(len(maybe)), number)
                    k = np.repeat(low - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum()) if len(maybe) else low
                    yield item[k], starts[maybe[own]] - offset[k], text[starts[maybe[own]]]

    def _enough(self, words, item, low, high, least) -> np.ndarray:
        """Whether low..high holds `least` words of the item: true of every leak, and quick to see for all
        candidates at once. A table of (item, word) bits answers; its errors cost time alone."""
        out = np.zeros(len(item), bool)
        ready = np.flatnonzero(high - low >= least)
        for part in np.array_split(ready, max(1, len(ready) // 20_000)):
            if not len(part):
                continue
            length = high[part] - low[part]
            edge = np.concatenate([[0], np.cumsum(length)])
            own = np.repeat(np.arange(len(part)), length)
            at = low[part][own] + np.arange(edge[-1]) - edge[own]
            known = self.known[_pair(words[at], item[part][own])]
            out[part] = np.add.reduceat(known, edge[:-1], dtype=np.int64) >= least[part]
        return out

    def _short_hits(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        out = set()
        for n, items in self.short.items():
            joined = _joined(words, n)
            for i in np.flatnonzero(np.isin(joined, np.array(list(items), np.uint64))).tolist():
                text = int(np.searchsorted(at, i, "right")) - 1
                if i + n <= at[text + 1]:
                    out |= {(text, k, 0) for k in items[int(joined[i])] if np.array_equal(words[i : i + n], self.words[k])}
        return list(out)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text number, item number, edits) of all leaks, one for each pair."""
        words, at = words_of(texts, DROP)
        if not len(words) or not self.words:
            return []
        exact_ = self._short_hits(words, at)
        if not self.tables:
            return sorted(exact_)
        hits = np.concatenate([np.stack(c) for c in self.candidates(words, at)], 1)
        # the item may hang over either end of the text, or both
        item, begin, doc = np.unique(hits, axis=1) if hits.size else hits
        size = np.array(self.size)[item]
        slack = (self.s.share * size).astype(np.int64)
        low, high = np.maximum(at[doc], begin - slack), np.minimum(at[doc + 1], begin + size + slack)
        best: dict[tuple[int, int], int] = {}
        for c in np.flatnonzero(self._enough(words, item, low, high, size - slack)).tolist():
            k, d, b, n = int(item[c]), int(doc[c]), int(begin[c]), int(size[c])
            if best.get((d, k), n) == 0:
                continue
            exact = at[d] <= b and b + n <= at[d + 1] and np.array_equal(words[b : b + n], self.words[k])
            found = 0 if exact else edits(self.bits[k], n, words[low[c] : high[c]].tolist())
            if found <= slack[c]:
                best[d, k] = min(best.get((d, k), n), found)
        return sorted([*exact_, *((d, k, n) for (d, k), n in best.items())])


def item_blocks(items: DataFrame, s: Settings) -> Iterator[tuple[list, list[bytes]]]:
    """The items (id, text), streamed to the driver in blocks of bounded size."""
    ids, texts, words = [], [], 0
    for item, text in items.toLocalIterator():
        size = len((text or "").split())
        if ids and words + size > s.block_words:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(item)
        texts.append((text or "").encode())
        words += size
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, *, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, edits, item_words) for every document and item found in it. items: item_id, text."""
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema.fields[0].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, item_id {kinds[1]}, edits int, item_words int"
    slim, found = docs.select(id_col, text_col), None
    for ids, texts in item_blocks(items, settings):
        shipped = spark.sparkContext.broadcast(Items(ids, texts, settings))

        def run(batches, shipped=shipped):
            for batch in batches:
                block, texts = shipped.value, utf8(batch.column(1))
                hits = [(a + d, k, n) for a, b in blocks(texts) for d, k, n in block.find(texts[a:b])]
                rows = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                item = pa.array([block.ids[h[1]] for h in hits], {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[1], pa.string()))
                yield pa.RecordBatch.from_arrays([rows, item, pa.array([h[2] for h in hits], pa.int32()), pa.array([block.size[h[1]] for h in hits], pa.int32())], names=[id_col, "item_id", "edits", "item_words"])

        one = slim.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, items: DataFrame, *, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item is found."""
    place = docs.columns.index(text_col)
    for ids, texts in item_blocks(items, settings):
        shipped = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, settings))
        docs = docs.mapInArrow(_keeper(shipped, place), docs.schema)
    return docs


def _keeper(shipped, place: int) -> Callable:
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(place))
            keep = np.ones(len(texts), bool)
            for a, b in blocks(texts):
                keep[[a + d for d, _, _ in shipped.value.find(texts[a:b])]] = False
            yield batch.filter(pa.array(keep))

    return run
