"""Quality classifier: a factorisation machine.

score = sigmoid(w0 + sum w_i x_i + sum over i<j of <v_i, v_j> x_i x_j). The pairwise part is found in
time linear in the features by the identity sum over factors of ((sum v_if x_i)^2 - sum v_if^2 x_i^2) / 2.

Features of a text: its words (A-Z lower-cased) hashed to `word_bins`, valued by damped counts of unit
length; and statistics of its structure (case, digits, punctuation, symbols, word and line lengths,
repeated words and lines, size), each as one indicator of a band and as a number. Metadata columns, if named, add
their indicators too. Ids, labels, languages and sources are not looked at.

Fitting takes at most `max_training_rows` labelled rows, the ones with the lowest seeded hash of their
id, so that bound, not the corpus, decides what the driver holds; it reads them part by part. Scoring reads every whole text once
and moves nothing: the model (a fixed number of floats) goes to the tasks.

Defined results: null counts as the empty text, which has a score like any other; null labels are not
learned from; without any usable label every score is 0.5; repeated label rows count repeatedly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, blocks, drop, id_text, mix, table, utf8, words_of
from .packed import give_back

BANDS = 16
#: Names of the statistics; each takes BANDS features after the word bins.
STATISTICS = ("upper", "digit", "mark", "symbol", "other_bytes", "space", "word_length", "long_words", "repeated_words", "line_length", "repeated_lines", "size", "top_word", "stutter")


@dataclass(frozen=True)
class Settings:
    word_bins: int = 1 << 16
    factors: int = 8
    steps: int = 600
    rate: float = 0.02
    decay: float = 1e-3
    batch: int = 256
    seed: int = 7
    max_training_rows: int = 20_000


def _band(x: np.ndarray) -> np.ndarray:
    """0 to BANDS - 1 for shares 0 to 1; finer near 0."""
    return np.minimum(BANDS - 1, (np.sqrt(np.clip(x, 0, 1)) * BANDS).astype(np.int64))


def _log_band(x: np.ndarray, step: float) -> np.ndarray:
    return np.clip((np.log2(1 + x) / step).astype(np.int64), 0, BANDS - 1)


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean length of lines, and share of bytes in lines seen before in the same text."""
    mean, repeated = np.zeros(len(texts)), np.zeros(len(texts))
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x]
        if lines:
            total = sum(map(len, lines))
            mean[i] = total / len(lines)
            repeated[i] = 1 - sum(map(len, set(lines))) / total
    return mean, repeated


def features(texts: list[bytes], settings: Settings, metadata: list[list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, indices, values): the features of text i are at offsets[i] to offsets[i + 1]."""
    n, bins = len(texts), settings.word_bins
    hashes, at = words_of(texts)
    per = np.diff(at)
    owner = np.repeat(np.arange(n), per)
    key = owner * bins + (mix(hashes, 1) % np.uint64(bins)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    own = key // bins
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(own, value**2, n))
    value = value / norm[own] if len(own) else value

    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    share = lambda mask: np.bincount(doc[mask], minlength=n) / np.maximum(1, sizes)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = np.bincount(doc[letter & (data < 97)], minlength=n) / np.maximum(1, np.bincount(doc[letter], minlength=n))
    words = np.maximum(1, per)
    first_of_doc = np.searchsorted(own, np.arange(n + 1))
    top = np.maximum.reduceat(np.append(count, 0), first_of_doc[:-1])[:n] * (np.diff(first_of_doc) > 0) if n else np.zeros(0)
    line, repeated = _lines(texts)
    space = share(_SPACE[data])
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    stutter = np.bincount(owner[same], minlength=n) / words
    bands = [
        _band(upper), _band(share((data >= 48) & (data <= 57))), _band(share((data == 33) | (data == 63))),
        _band(share((data == 124) | (data == 60) | (data == 62) | (data == 123) | (data == 125) | (data == 35) | (data == 64) | (data == 95) | (data == 47))),
        _band(share(data >= 128)), _band(space), _log_band(sizes * (1 - space) / words, 0.4), _log_band(100 * space, 0.45),
        _band(1 - np.diff(first_of_doc) / words), _log_band(line, 0.9), _band(repeated), _log_band(sizes, 1.4), _band(top / words), _band(stutter),
    ]
    columns = [bins + k * BANDS + b for k, b in enumerate(bands)]
    first = bins + len(STATISTICS) * (BANDS + 1)
    for k, column in enumerate(metadata or []):
        codes = [first + k * 256 + int(mix(np.array([hash_text(v)], np.uint64))[0] & np.uint64(255)) for v in column]
        columns.append(np.array(codes, np.int64))
    # each statistic once more as a number, so that neighbouring bands speak for each other
    columns += [np.full(n, bins + len(STATISTICS) * BANDS + k) for k in range(len(bands))]
    dense = np.stack(columns, 1) if n else np.zeros((0, len(columns)), np.int64)
    worth = np.concatenate([np.full((n, len(columns) - len(bands)), 0.5), np.stack(bands, 1) / (BANDS - 1)], 1) if n else np.zeros((0, len(columns)))
    counts = np.diff(first_of_doc) + dense.shape[1]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    index, weight = np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.float32)
    place = np.arange(len(key)) + own * dense.shape[1]
    index[place], weight[place] = key % bins, value
    spots = (offsets[1:, None] - dense.shape[1] + np.arange(dense.shape[1])) if n else np.zeros((0, 0), np.int64)
    index[spots], weight[spots] = dense, worth
    return offsets, index, weight


def hash_text(value) -> int:
    import zlib

    return zlib.crc32(str(value).encode()) if value is not None else 0


@dataclass
class Model:
    """Weights of a factorisation machine; `flat` scores everything alike, where nothing could be learned."""

    settings: Settings
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, offsets: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        sums = self.sums(offsets, index, value)
        return self.bias + sums[0] + 0.5 * (sums[1] ** 2 - sums[2]).sum(1)

    def sums(self, offsets, index, value):
        """Per text: sum w x; sum v x by factor; sum v^2 x^2 by factor. Every text has features."""
        if len(offsets) == 1:
            k = self.factors.shape[1]
            return np.zeros(0), np.zeros((0, k)), np.zeros((0, k))
        vx = self.factors[index] * value[:, None]
        begin = offsets[:-1]
        return np.add.reduceat(self.linear[index] * value, begin), np.add.reduceat(vx, begin), np.add.reduceat(vx * vx, begin)

    def score(self, texts: list[bytes], metadata: list[list] | None = None) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in blocks(texts, 1 << 20):
            out[a:b] = self.logits(*features(texts[a:b], self.settings, [m[a:b] for m in metadata or []]))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings, n_metadata: int = 0) -> Model:
    """Logistic loss by `steps` Adam steps over shuffled batches, however few or many the rows; both labels weigh
    alike, so that 0.5 lies between them where one is rare. The same rows in the same order give the same model."""
    size = settings.word_bins + len(STATISTICS) * (BANDS + 1) + 256 * n_metadata
    rng = np.random.default_rng(settings.seed)
    model = Model(settings, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, settings.factors)).astype(np.float32))
    if not len(rows):
        model.factors[:] = 0
        return model
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)  # both labels weigh alike
    first = {k: np.zeros_like(v) for k, v in (("b", np.zeros(1, np.float32)), ("w", model.linear), ("v", model.factors))}
    second, bias, step = {k: np.zeros_like(v) for k, v in first.items()}, np.zeros(1, np.float32), 0
    whole = np.zeros(1, np.int64)
    while step < settings.steps:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            pick, step = order[at : at + settings.batch], step + 1
            if step > settings.steps:
                break
            offsets = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            index = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick])
            linear, vx, v2 = model.sums(offsets, index, value)
            p = 1 / (1 + np.exp(-np.clip(bias[0] + linear + 0.5 * (vx**2 - v2).sum(1), -30, 30)))
            error = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            per = np.repeat(np.arange(len(pick)), np.diff(offsets))
            e = error[per] * value
            touched, inverse = np.unique(index, return_inverse=True)
            gw = np.bincount(inverse, e, len(touched))
            own = model.factors[index]
            g = e[:, None] * (vx[per] - own * value[:, None])
            gv = np.stack([np.bincount(inverse, g[:, f], len(touched)) for f in range(settings.factors)], 1)
            for name, target, grad, at_ in (("b", bias, error.sum(keepdims=True), whole), ("w", model.linear, gw, touched), ("v", model.factors, gv, touched)):
                grad = (grad + settings.decay * target[at_]).astype(np.float32)
                m = first[name][at_] = 0.9 * first[name][at_] + 0.1 * grad
                s = second[name][at_] = 0.99 * second[name][at_] + 0.01 * grad**2
                target[at_] -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    model.bias = float(bias[0])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, may_learn: Column, settings: Settings, *, id_col: str, label_col: str) -> DataFrame:
    """Text and label of the labelled rows that may be learned from, at most `max_training_rows` of them."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label"))
        .where(may_learn).orderBy(F.xxhash64(id_text(F.col("__id")), F.lit(settings.seed)), "__id", "__label").limit(settings.max_training_rows)
    )
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id"))  # bounded by the limit


def train(docs: DataFrame, labels: DataFrame, may_learn, *, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ()) -> Model:
    """`may_learn`: a function from the id column to the condition under which a label may be used."""
    rows = training_rows(docs, labels, may_learn(F.col("__id")), settings, id_col=id_col, label_col=label_col)

    def run(batches):
        for batch in batches:
            texts, out = utf8(batch.column(2)), []
            extra = [batch.column(3 + k).to_pylist() for k in range(len(metadata))]
            for a, b in blocks(texts, 1 << 20):
                offsets, index, value = features(texts[a:b], settings, [m[a:b] for m in extra])
                out += [(index[x:y].tobytes(), value[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["id", "label", "i", "v"])

    found = table(rows.select(id_text(F.col("__id")).alias("id"), F.col("__label").alias("label"), text_col, *metadata).mapInArrow(run, "id string, label double, i binary, v binary"), "quality-rows")
    got = sorted((r["id"], r["label"], bytes(r["i"]), bytes(r["v"])) for r in found.coalesce(8).toLocalIterator())  # a part at a time
    drop(found)
    model = fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, _, i, v in got], np.array([label for _, label, _, _ in got], np.float32), settings, len(metadata))
    del got
    give_back()
    return model


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", metadata: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, and score."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    slim = docs.select(*keep, F.col(text_col).alias("__text"), *[F.col(c).alias(f"__m{k}") for k, c in enumerate(metadata)])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n = len(keep)
            got = shipped.value.score(utf8(batch.column(n)), [batch.column(n + 1 + k).to_pylist() for k in range(len(metadata))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(got, pa.float64())], names=[*batch.schema.names[:n], "score"])

    return slim.mapInArrow(run, T.StructType([*slim.select(*keep).schema.fields, T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, cut: float, *, text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs whose score is `cut` or more."""
    place, more = docs.columns.index(text_col), [docs.columns.index(c) for c in metadata]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = shipped.value.score(utf8(batch.column(place)), [batch.column(k).to_pylist() for k in more])
            yield batch.filter(pa.array(got >= cut))

    return docs.mapInArrow(run, docs.schema)
