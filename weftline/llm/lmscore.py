"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words (A-Z lower-cased) and one end per text. A context of k tokens is looked at if it was seen
`least` times (2); it stores the symbols seen `least` times behind it, if the gram without its first token
was looked at and seen as often; the others share its remainder. It is a state of the tree if its
next-token distribution diverges from that of the longest state that is a suffix of it: the log-likelihood
that it wins on the training counts must exceed `penalty` for each symbol it stores. If `sure` is set, contexts
seen that often are states without a test. So a context's length follows the text, up to `depth` tokens; all minima
are absolute numbers, alike at every size, and the tree grows with the corpus. A state's distribution is
smoothed with that of its longest suffix state; the root's with a slot for unknown words, by absolute
discounting. A token is scored by the longest state that is a suffix of what precedes it.

How it runs: texts become blocks of token numbers once. For each order, every block sends its distinct
contexts with their grams and counts to routes by the context's hash; a route adds up, tests, and tells each
block what its contexts and grams got. The grams of a context seen `spread` times go by the gram's hash, so that
none fills a route; such contexts are tested alike, their sums being added up over the routes in two steps. Gains
are whole multiples of 1 / GAIN, so where a context is tested does not change its result. No text is moved after
the first step, no model is broadcast but one row for each spread context (65,536 at most: beyond 2**35 tokens
their number decides, not 2**19 occurrences), and in the end each block adds up the scores of its own texts.

Log probabilities are base 10 and whole multiples of 1 / SCALE, so sums do not depend on order. Defined
results: null, empty and blank texts are one end token; null ids count as the empty text when rows are
held out; without training rows N and V are 0; an empty table gives an empty table; equal texts get equal
scores. Other columns play no part. Words are known by 64-bit hashes, contexts by 48 bits,
symbols by 40 bits behind one token and 32 behind more. A task holds the tokens of one block: `block_bytes` of text or one longer text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, drop, mix, table, utf8, words_of
from .packed import NOBODY, SENT, answered, met, pack, route_bits, rows, signed, steps, summed, told, unpack, unsigned

END = np.uint64(0x656E64656E64656E)
START = np.uint64(0x7374617274737461)  # stands before a text's first token; only order 1 sees it
ODD = np.uint64(0x9E3779B97F4A7C15)
LOW = (np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1))  # of a symbol's code, behind one token and behind more
SHORT = np.uint64(16)  # bits of a context's code that are not sent
SCALE = float(1 << 20)
GAIN = float(1 << 16)
SPREAD = -2  # the block of rows that hold the grams of spread contexts


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    least: int = 2
    penalty: float = 2.0
    discount: float = 0.5
    sure: float = float("inf")
    spread: int = 1 << 19
    block_bytes: int = 1 << 23
    route_entries: int = 1_500_000


@dataclass(frozen=True)
class Root:
    """Counts of the training tokens: all, distinct, seen once and seen twice."""

    n: int
    v: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def logs(self, count: np.ndarray) -> np.ndarray:
        """Log probability of tokens by their counts, in 1 / SCALE; 0 stands for unknown words."""
        return _whole(np.log10(np.where(count > 0, count - self.discount, self.discount * self.v or 1) / max(1, self.n)))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int64)


# ---------------------------------------------------------------- blocks of tokens


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and offsets, with the end token of each text."""
    words, at = words_of(texts)
    n = len(texts)
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))] = words
    return out, at + np.arange(n + 1)


def token_blocks(docs: DataFrame, learns: Column, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, ids, n_tokens, data): the training mark and size of each text, the block's distinct words,
    frequent ones first, and the tokens as places in that list."""
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col(text_col).alias("text"))

    def packed(ids: list, marks: list, texts: list[bytes]) -> pa.RecordBatch:
        parts = [tokens_of(texts[a:b]) for a, b in blocks(texts)]
        tokens = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([np.diff(p[1]) for p in parts])
        words, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
        by = np.argsort(-count, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        data = pack(np.concatenate(marks), sizes, steps(words[by]), place[number])  # words of one count stand in order
        flat = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([len(tokens)], pa.int64()), pa.array([data], pa.binary())], names=["ids", "n_tokens", "data"])

    def run(batches):
        ids, marks, texts, size = [], [], [], 0
        for batch in batches:
            own = utf8(batch.column(2))
            for a, b in blocks(own, 1 << 20):
                ids.append(batch.column(0)[a:b])
                marks.append(batch.column(1)[a:b].to_numpy(zero_copy_only=False).astype(np.uint64))
                texts += own[a:b]
                size += sum(map(len, own[a:b]))
                if size >= s.block_bytes:
                    yield packed(ids, marks, texts)
                    ids, marks, texts, size = [], [], [], 0
        if texts:
            yield packed(ids, marks, texts)

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType())])
    return table(slim.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


# ---------------------------------------------------------------- the root


def _cuts(route: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(route, np.arange((1 << bits) + 1))


def word_counts(tokens: DataFrame, bits: int) -> DataFrame:
    """Answers: for each block and route, the training counts of the block's words, by hash; for the driver
    the four numbers of Root."""

    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks, sizes, words, token = unpack(data)
                words, token = summed(words), token.astype(np.int64)
                count = np.bincount(token[np.repeat(marks, sizes.astype(np.int64)) > 0], minlength=len(words))
                by = np.argsort(words)
                cut = _cuts((words[by] >> np.uint64(64 - bits)).astype(np.int64), bits)
                yield rows([(block, r, pack(steps(words[by[a:b]]), count[by[a:b]])) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a])

    def add(route, asked, data):
        got = [unpack(d) for d in data]
        words, number = np.unique(np.concatenate([summed(g[0]) for g in got]), return_inverse=True)
        total = np.bincount(number, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
        edge = np.cumsum([0] + [len(g[0]) for g in got])
        out = [(block, pack(total[number[a:b]])) for block, a, b in zip(asked, edge[:-1], edge[1:])]
        return [*out, (NOBODY, pack(np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()])))]

    return table(answered(tokens.select("block", "data").mapInArrow(send, SENT), add), "lm-words")


# ---------------------------------------------------------------- states


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, keys ascending; for each key its number among them)."""
    bits = max(1, len(key).bit_length())
    if len(key) and key.dtype == np.int64 and int(key.max()).bit_length() + bits < 64:  # key and place in one number
        both = np.sort((key << bits) | np.arange(len(key)))
        order, sorted_ = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key)
        sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


@dataclass
class Order:
    """What a block sends for one order. Tokens whose context is looked at (`at`), the context of each; the
    contexts' codes, counts and whether they are seen `spread` times. Of the tokens whose gram is looked at
    (`own`, places in `at`): the gram of each; the grams' contexts, codes one order below and what is sent of
    them, training counts and log probabilities one order below. Rows of (route, context): `pairs`; the grams in order of these rows: `dealt`."""

    at: np.ndarray
    context: np.ndarray
    codes: np.ndarray
    seen: np.ndarray
    spread: np.ndarray
    own: np.ndarray
    gram: np.ndarray
    gram_context: np.ndarray
    code: np.ndarray
    low: np.ndarray
    count: np.ndarray | None
    below: np.ndarray
    pairs: np.ndarray
    dealt: np.ndarray
    cut: np.ndarray
    gram_cut: np.ndarray


class Block:
    """A block's tokens, and what is known of them after each order."""

    def __init__(self, data: bytes, counts: list[bytes], root: Root, s: Settings):
        marks, sizes, words, token = unpack(data)
        words = summed(words)
        self.s, self.root, self.sizes = s, root, sizes.astype(np.int64)
        token = token.astype(np.int64)
        by = np.argsort(words)
        count = np.empty(len(words), np.int64)
        count[by] = np.concatenate([unpack(c)[0] for c in counts])
        self.learns = np.repeat(marks, self.sizes) > 0
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.place = np.arange(len(token)) - np.repeat(self.first, self.sizes)
        self.token, self.word_count = token, count
        self.log = root.logs(count)[token]
        # the gram that ends at each token, by number, the last number for none; the grams' codes and training counts
        self.gram, self.code, self.seen = token.astype(np.int32), np.append(words, np.uint64(0)), np.append(count, 0)
        self.order = 0

    def next(self, bits: int, texts: int, counts: bool = True) -> Order:
        """The next order's contexts and grams, with their counts if they are to be sent."""
        s, k = self.s, self.order + 1
        often, none = (self.seen >= s.least)[self.gram], len(self.seen) - 1
        # the context of a token is the gram that ends before it; `none` stands for the start of a text
        fits = np.append(False, often[:-1])
        if k == 1:
            fits[self.first] = texts >= s.least
        else:
            fits &= self.place >= k
        at = np.flatnonzero(fits)
        name = self.gram[at - 1]
        if k == 1:
            name[self.place[at] == 0] = none
        met_ = np.zeros(none + 1, bool)
        met_[name] = True
        names = np.flatnonzero(met_)
        codes, times = self.code[names], self.seen[names]
        if k == 1 and len(names) and names[-1] == none:
            codes[-1], times[-1] = START, texts
        by = np.argsort(codes)
        codes, times, rank = codes[by], times[by], np.empty(none + 1, np.int64)
        rank[names[by]] = np.arange(len(by))
        context = rank[name]
        spread = times >= self.spread
        own = np.flatnonzero(often[at])
        below_gram, own_context = self.gram[at[own]], context[own]
        first, gram = _grouped(own_context * (none + 1) + below_gram)
        gram_context = own_context[first]
        code = self.code[below_gram[first]]
        low = code & LOW[k > 1]
        count = np.bincount(gram[self.learns[at[own]]], minlength=len(first)) if counts else None
        route = (codes >> np.uint64(64 - bits)).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        n = max(1, len(codes))
        if spread.any():
            by_gram = (mix(codes[gram_context] ^ low, 17) >> np.uint64(64 - bits)).astype(np.int64)
            pair = np.where(spread[gram_context], by_gram, route[gram_context]) * n + gram_context
            pairs = np.unique(np.concatenate([pair, (route * n + np.arange(len(codes)))[~spread]]))
            dealt = np.argsort(pair, kind="stable")
        else:
            pair = route[gram_context] * n + gram_context  # in order already
            pairs, dealt = route * n + np.arange(len(codes)), np.arange(len(pair))
        ends = np.arange((1 << bits) + 1) * n
        return Order(at, context, codes, times, spread, own, gram, gram_context, code, low, count, self.log[at[own[first]]], pairs, dealt, np.searchsorted(pairs, ends), np.searchsorted(pair[dealt], ends))

    def sent(self, o: Order) -> list[tuple[int, bytes]]:
        """(route, data) of an order."""
        n, out = max(1, len(o.codes)), []
        pair = (np.zeros(0, np.int64) if not len(o.dealt) else self._pair_of(o)[o.dealt])
        for r, (a, b, c, d) in enumerate(zip(o.cut[:-1], o.cut[1:], o.gram_cut[:-1], o.gram_cut[1:])):
            if b > a:
                context, g = o.pairs[a:b] % n, o.dealt[c:d]
                number = np.diff(np.searchsorted(pair[c:d], np.append(o.pairs[a:b], o.pairs[b - 1] + 1)))
                out.append((r, pack(steps(o.codes[context] >> SHORT), o.seen[context], number, o.low[g], o.count[g], signed(-o.below[g]))))
        return out

    def _pair_of(self, o: Order) -> np.ndarray:
        number = np.empty(len(o.dealt), np.int64)
        spread = np.repeat(np.arange(len(o.cut) - 1), np.diff(o.gram_cut))
        number[o.dealt] = spread * max(1, len(o.codes)) + o.gram_context[o.dealt]
        return number

    def learn(self, o: Order, got: list[bytes], hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Take what the routes answered about the order. hot: codes, numbers of stored symbols and their counts
        of the spread contexts."""
        parts = [unpack(d) for d in got]
        whole = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64)
        back = np.zeros(len(o.codes), np.int64)
        back[o.pairs % max(1, len(o.codes))] = -whole(0).astype(np.int64)
        count = np.zeros(len(o.dealt), np.int64)
        count[o.dealt] = whole(1).astype(np.int64)
        if o.spread.any() and len(hot[0]):
            which = np.flatnonzero(o.spread)
            at = np.minimum(np.searchsorted(hot[0], o.codes[which] >> SHORT), len(hot[0]) - 1)
            live = (hot[0][at] == o.codes[which] >> SHORT) & (hot[1][at] > 0)
            back[which] = np.where(live, _back(o.seen[which], hot[1][at], hot[2][at], self.s), 0)
        stored = (count >= self.s.least) & (back[o.gram_context] < 0)
        kept = np.flatnonzero(stored)
        log, c = np.zeros(len(count), np.int64), o.gram_context[kept]
        log[kept] = _whole(np.log10((count[kept] - self.s.discount) / (o.seen[c] + 1.0) + 10 ** ((back[c] + o.below[kept]) / SCALE)))
        shut = back[o.context]  # of each token in `at`
        new, stored = self.log[o.at] + shut, stored[o.gram]
        new[o.own[stored]] = log[o.gram[stored]]
        self.order += 1
        self.code = np.append(mix(o.codes[o.gram_context] * ODD + o.code, self.order), np.uint64(0))
        self.seen = np.append(count, 0)
        self.gram = np.full(len(self.log), len(count), np.int32)
        self.gram[o.at[o.own]] = o.gram
        self.log[o.at] = new

    @property
    def spread(self) -> int:
        return max(self.s.spread, self.root.n >> 16)


def _back(seen: np.ndarray, symbols: np.ndarray, held: np.ndarray, s: Settings) -> np.ndarray:
    """Log of the share that a state leaves to the symbols that it does not store, in 1 / SCALE, below 0."""
    return np.minimum(-1, _whole(np.log10((seen - held + s.discount * symbols + 1) / (seen + 1.0))))


def _gains(c: np.ndarray, t: np.ndarray, p: np.ndarray, seen: np.ndarray, symbols: np.ndarray, held: np.ndarray, s: Settings) -> np.ndarray:
    """What each context wins on the symbols it stores, in 1 / GAIN: c, t and p are their contexts, counts and log
    probabilities one order below."""
    below = 10 ** (p / SCALE)
    own = (t - s.discount + (seen - held + s.discount * symbols + 1)[c] * below) / (seen + 1.0)[c]
    out = np.zeros(len(seen), np.int64)
    np.add.at(out, c, np.rint(GAIN * t * np.log(own / below)).astype(np.int64))
    return out


def _live(gains: np.ndarray, seen: np.ndarray, symbols: np.ndarray, held: np.ndarray, s: Settings) -> np.ndarray:
    """Which contexts are states. gains: on all symbols that they store."""
    rest = np.rint(GAIN * (seen - held) * np.log((seen - held + s.discount * symbols + 1) / (seen + 1.0))).astype(np.int64)
    won = gains + rest > GAIN * s.penalty * symbols
    return (symbols > 0) & (won | (seen >= s.sure))


def _tested(route: int, asked: list[int], data: list[bytes], spread: int, s: Settings) -> list[tuple[int, bytes]]:
    """A route's contexts: answers are the back-off of each context (0: no state, or a spread one) and the count of
    each gram. For the driver: numbers of states and of stored symbols. Of spread contexts: the grams they store."""
    got = [unpack(d) for d in data]
    codes = np.concatenate([summed(g[0]) for g in got])
    number = np.concatenate([g[2] for g in got]).astype(np.int64)
    low, count, below = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
    below = -unsigned(below)
    first, context = _grouped(codes)
    names, seen = codes[first], np.concatenate([g[1] for g in got]).astype(np.int64)[first]
    of_gram = np.repeat(context, number)
    head, group = _grouped(mix(names, 23)[of_gram] + low * ODD)  # low tells grams of one context apart
    total = np.bincount(group, count, len(head)).astype(np.int64)
    c, p, size = of_gram[head], below[head], len(names)
    stored = total >= s.least
    c, p, t = c[stored], p[stored], total[stored]
    symbols, held = np.bincount(c, minlength=size), np.bincount(c, t, size)
    is_spread = seen >= spread
    inside = ~is_spread[c]
    live = _live(_gains(c[inside], t[inside], p[inside], seen, symbols, held, s), seen, symbols, held, s) & ~is_spread
    back = np.where(live, _back(seen, symbols, held, s), 0)
    edge, gram_edge = np.cumsum([0] + [len(g[0]) for g in got]), np.cumsum([0] + [len(g[3]) for g in got])
    out = [(block, pack(-back[context[a:b]], total[group[i:j]])) for block, a, b, i, j in zip(asked, edge[:-1], edge[1:], gram_edge[:-1], gram_edge[1:])]
    if not inside.all():
        hot = np.flatnonzero(is_spread)
        out.append((SPREAD, pack(names[hot], seen[hot], np.searchsorted(hot, c[~inside]), t[~inside], signed(p[~inside]))))
    return [*out, (NOBODY, pack(np.array([int(live.sum()), int(stored.sum())])))]


def _spread_contexts(answers: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the spread contexts, ascending, how many symbols each stores (0: no state) and the counts of these."""

    def summed_up(run, *columns: str) -> list[np.ndarray]:
        rows_ = answers.where(F.col("block") == SPREAD).select("data").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("code", *columns)))
        got = [tuple(r) for r in rows_.groupBy("code").agg(*[(F.max if c == "seen" else F.sum)(c) for c in columns]).toLocalIterator()]
        table_ = np.array(sorted(got), np.int64).reshape(-1, 1 + len(columns))
        return list(table_.T)

    def count(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                codes, seen, c, t, _ = unpack(data)
                c = c.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (codes, seen, np.bincount(c, minlength=len(codes)), np.bincount(c, t, len(codes)))], names=["code", "seen", "symbols", "held"])

    codes, seen, symbols, held = summed_up(count, "seen", "symbols", "held")  # codes have 48 bits

    def gain(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own, _, c, t, p = unpack(data)
                at = np.searchsorted(codes, own.astype(np.int64))
                won = _gains(c.astype(np.int64), t.astype(np.int64), unsigned(p), seen[at], symbols[at], held[at], s)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(won)], names=["code", "won"])

    won = summed_up(gain, "won")[1] if len(codes) else held
    return codes.astype(np.uint64), np.where(_live(won, seen, symbols, held.astype(np.float64), s), symbols, 0).astype(np.float64), held.astype(np.float64)


# ---------------------------------------------------------------- training and scoring


@dataclass
class Tree:
    """What the blocks have been told of each order; the spread contexts of each order."""

    tokens: DataFrame
    root: Root
    bits: int
    texts: int
    answers: list[DataFrame]
    hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    states: list[int]


def _known(data: bytes, got: dict[int, list[bytes]], orders: int, root: Root, bits: int, texts: int, hot: list, s: Settings) -> Block:
    """The block after so many orders."""
    block = Block(data, got.get(0, []), root, s)
    for k in range(1, orders + 1):
        block.learn(block.next(bits, texts, counts=False), got.get(k, []), hot[k - 1])
    return block


def train(docs: DataFrame, learns: Column, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> Tree:
    """The tree of the rows where `learns` holds, and the blocks of all rows."""
    s = settings
    tokens = token_blocks(docs, learns, s, id_col, text_col)
    size = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    bits = route_bits(size * 0.55, s.route_entries)
    words = word_counts(tokens, bits)
    root = Root(*[int(x) for x in np.sum([unpack(d)[0] for _, d in told(words)] or [np.zeros(4, np.uint64)], 0)])
    texts = 0  # the training texts: the count of their end token

    def ends(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([int(unpack(data)[0].sum())])], names=["texts"])

    texts = tokens.select("data").mapInArrow(ends, "texts bigint").agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    tree = Tree(tokens, root, bits, texts, [words], [], [])
    for order in range(1, s.depth + 1):
        spread = max(s.spread, root.n >> 16)
        hot = list(tree.hot)

        def send(block: pa.Table, got: dict[int, list[bytes]], order=order, hot=hot) -> pa.Table:
            one = _known(block.column("data")[0].as_py(), got, order - 1, root, bits, texts, hot, s)
            found = one.sent(one.next(bits, texts))
            number = block.column("block")[0].as_py()
            return pa.Table.from_batches([rows([(number, r, d) for r, d in found])])

        sent = met(tokens.select("block", "data"), tree.answers, send, SENT)
        answers = table(answered(sent, lambda route, asked, data: _tested(route, asked, data, spread, s)), f"lm-states-{order}")
        live, kept = 0, 0
        for _, data in told(answers):
            states = unpack(data)[0]
            live, kept = live + int(states[0]), kept + int(states[1])
        if not kept:
            drop(answers)
            break
        tree.answers.append(answers)
        tree.hot.append(_spread_contexts(answers, s))
        tree.states.append(live + int((tree.hot[-1][1] > 0).sum()))
    return tree


def scored(tree: Tree, settings: Settings = Settings(), *, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, base_score, score for every row that the tree's blocks hold."""
    root, bits, texts, hot, s = tree.root, tree.bits, tree.texts, tree.hot, settings
    kind = tree.tokens.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(block: pa.Table, got: dict[int, list[bytes]]) -> pa.Table:
        one = _known(block.column("data")[0].as_py(), got, len(hot), root, bits, texts, hot, s)
        add = lambda x: np.add.reduceat(x, one.first)  # noqa: E731  every text has its end
        base = np.log10((one.word_count + 1) / (root.n + root.v + 1))[one.token]
        ids = block.column("ids").combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(one.sizes), pa.array(add((one.word_count > 0).astype(np.int64)[one.token])), pa.array(add(base)), pa.array(add(one.log) / SCALE)], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    return met(tree.tokens, tree.answers, run, schema)


def score_all(docs: DataFrame, learns: Column, *, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Scores of all rows by a tree of those where `learns` holds, and the number of tokens learned from."""
    tree = train(docs, learns, settings, id_col=id_col, text_col=text_col)
    return scored(tree, settings, id_col=id_col), tree.root.n
