"""N-gram Jaccard join, size-aware: light sets enumerate fixed-size subsets, heavy sets scan inverted
lists, and the boundary between them is the one of least estimated cost.

Two sets of sizes n and m with Jaccard similarity 0.8 or more share at least ceil(0.8 * max(n, m))
shingles. So, in any fixed order of shingles, both have the same first l shared shingles among their
first n - ceil(0.8 n) + l. Light sets (n <= boundary) are listed under every 2-subset of that prefix
for l = 2; heavy sets, and the light ones whose size can meet a heavy one, under every shingle of the
prefix for l = 1. Both are lossless. The order is by rarity: a fixed-size table of counts over all
shingles of all documents (hash bucket -> number of documents) comes first, the hash breaks ties, so
what many documents share is last and hardly ever listed.

Documents with equal sets form a class and only its representative goes on. Of lists with the same
members one is kept. Members of a list are compared by parity maps (a lossless bound on the sets' difference,
of a power of two bits, as many as the set has shingles and 1,024 at least) first: short lists by a join, long ones in blocks of fixed size, each of which hands
over no more than a spanning forest of what the maps allow. The components of these candidates are
clusters: any similar pair lies within one. Each cluster's whole sets of 64-bit shingle hashes come
together once, again in blocks if it is large; pairs are verified nearest first, those that links have
joined already are skipped, and a block hands over a spanning forest of true links. So no group is
expanded into its pairs, and no link between different texts is lost. Of more than `FEW` blocks, one meets
all others first; only members that this has not joined to the largest part then meet the rest, so a
set in a group of a million copies moves a few times and not once for each block.

Defined results: A-Z are lower-cased; a text with fewer than `width` words is one shingle, the whole
sequence; null, empty and blank texts have no shingles and are linked with nothing, not even each
other; ids may repeat or be null: every row is judged by its own text, and the smallest id that is
not null names the component; an empty table gives an empty table. Other columns play no part.
Sets are known by 64-bit hashes of their sorted shingles, shingles by 64-bit hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, drop, mix, table, utf8, words_of
from .components import components

WIDTH = 5
SKETCH_BITS = 20
CHUNK = 1 << 14
LEAST_MAP = 1024  # bits
SMALL_LIST = 32
BLOCK = 512
FEW = 16  # blocks of a list or cluster that are compared each with each
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    words, at = words_of(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled = rolled * _STEP + words[j : n + j]
    rolled = mix(rolled, width)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * _STEP + w
            out.append(mix(h, 1000 + int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _each(column, width: int):
    texts = utf8(column)
    for a, b in blocks(texts):
        yield from shingle_sets(texts[a:b], width)


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def shingle_counts(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Number of documents by hash bucket of their shingles: 2**20 numbers, whatever the corpus.

    Tasks count on their own; the tables are added up by chunk as a stream, so no task holds more than
    its chunks."""

    def count(batches):
        total, seen = np.zeros(1 << SKETCH_BITS, np.int64), False
        for batch in batches:
            for s in _each(batch.column(0), width):
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                seen = True
        if seen:
            parts = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.int32).tobytes() if p.max() < 1 << 31 else p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def numbers(data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.int32 if len(data) == 4 * CHUNK else np.int64)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[chunk] = totals.get(chunk, 0) + numbers(data).astype(np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = texts.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in summed.collect():  # 64 rows
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = numbers(bytes(row["counts"]))
    return out


SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
    T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("load", T.LongType()), T.StructField("map", T.ArrayType(T.LongType())), T.StructField("lead", T.BooleanType()),
])


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """For each value of the hashes' low bits, whether a set has an odd number of such shingles. The
    exclusive or of a map's halves is the map of half the size."""
    bits = max(LEAST_MAP, 1 << (len(shingles) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


class Maps:
    """Maps of several sets, for the least differences between one and many."""

    def __init__(self, maps: list[np.ndarray]):
        self.kind = np.array([len(m).bit_length() for m in maps])
        self.row, self.full, self.half = np.empty(len(maps), np.int64), {}, {}
        for kind in np.unique(self.kind).tolist():
            own = np.flatnonzero(self.kind == kind)
            self.row[own] = np.arange(len(own))
            whole = self.full[kind] = np.stack([maps[i] for i in own])
            middle = whole.shape[1] // 2
            self.half[kind] = whole[:, :middle] ^ whole[:, middle:]

    def differences(self, k: int, others: np.ndarray) -> np.ndarray:
        """At least so many shingles are in one of k and each other set only. Sets of similarity 0.8 or
        more have maps of one size or the next; others count as far apart."""
        out, own = np.full(len(others), 1 << 60), int(self.kind[k])
        for kind in (own - 1, own, own + 1):
            at = np.flatnonzero(self.kind[others] == kind)
            if len(at):
                many = (self.half if kind > own else self.full)[kind][self.row[others[at]]]
                one = (self.half if kind < own else self.full)[own][self.row[k]]
                out[at] = np.bitwise_count(many ^ one).sum(1, dtype=np.int64)
        return out


def node_of(shingles: np.ndarray) -> int:
    """64-bit hash of a set."""
    return int(mix(mix(shingles, 11).sum(dtype=np.uint64, keepdims=True), len(shingles)).view(np.int64)[0])


def needed(n: int) -> int:
    """Shingles that a set of size n shares with any similar set, at least: ceil(0.8 n)."""
    return -(-4 * n // 5)


def described_sets(docs: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """One row of SETS per document: size, hash of the set, prefix for l = 2 in order of rarity,
    how often the prefix for l = 1 occurs by the counts, and the parity map. `lead` is set for the first
    row of a set in a task; the copies behind it carry the hash only."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            table_of = shipped.value
            noise = int(np.median(table_of))
            size, nodes, prefixes, loads, maps, lead = [], [], [], [], [], []
            for s in _each(batch.column(1), width):
                n = len(s)
                often = np.minimum(table_of[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 20) - 1)
                order = np.argsort((often.astype(np.uint64) << np.uint64(44)) | (s & np.uint64((1 << 44) - 1)), kind="stable")
                p = n - needed(n) + 1
                size.append(n)
                nodes.append(node_of(s))
                lead.append(n >= 4 and nodes[-1] not in seen)
                seen.add(nodes[-1])
                if not lead[-1]:
                    prefixes.append(np.zeros(0, np.int64))
                    loads.append(0)
                    maps.append(np.zeros(0, np.int64))
                    continue
                prefixes.append(_longs(s[order[: p + 1]]))
                loads.append(int(np.maximum(0, often[order[:p]] - noise).sum()))
                maps.append(parity_map(s).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (size, nodes)], _long_lists(prefixes), pa.array(loads, pa.int64()), _long_lists(maps), pa.array(lead, pa.bool_())],
                schema=pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("prefix", pa.list_(pa.int64())), ("load", pa.int64()), ("map", pa.list_(pa.int64())), ("lead", pa.bool_())]),
            )

    return docs.mapInArrow(run, SETS)


def boundary_of(reps: DataFrame, candidates: tuple[int, ...] = (0, 6, 8, 10, 12, 16, 20, 24, 32, 40)) -> int:
    """The largest light size of least cost: rows of 2-subsets for light sets, against rows and expected
    list members for the inverted lists. Read off the sizes below the largest candidate."""
    top = max(candidates) * 5 // 4 + 1
    by_size = {r["n"]: (r["sets"], r["load"]) for r in reps.where(F.col("n") <= top).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("load").alias("load")).collect()}

    def cost(x: int) -> float:
        total = 0.0
        for n, (sets, load) in by_size.items():
            p = n - needed(n) + 1
            total += sets * p * (p + 1) / 2 if n <= x else 0
            total += sets * p + load if 5 * n > 4 * x else 0
        return total

    return min(candidates, key=lambda x: (cost(x), x))


def postings(reps: DataFrame, boundary: int) -> DataFrame:
    """(key, node, n): the lists. Keys of subsets and of single shingles may meet by chance only."""
    light = reps.where((F.col("n") >= 4) & (F.col("n") <= boundary))
    subsets = F.flatten(
        F.transform("prefix", lambda x, i: F.transform(F.slice(F.col("prefix"), i + 2, F.size("prefix")), lambda y: F.xxhash64(x, y)))
    )
    heavy = reps.where((F.col("n") >= 4) & (5 * F.col("n") > 4 * boundary))
    single = F.slice(F.col("prefix"), F.lit(1), F.greatest(F.size("prefix") - 1, F.lit(1)))
    return heavy.select(F.explode(single).alias("key"), "node", "n").unionByName(light.select(F.explode(subsets).alias("key"), "node", "n"))


def _size_fits(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _maps_fit(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Sets of similarity 0.8 or more differ in at most a ninth of their joint size, and so do their maps.
    Of maps of two sizes, the larger is folded."""
    middle = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), middle(x)), F.slice(x, middle(x) + 1, middle(x)), lambda p, q: p.bitwiseXOR(q))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    least = F.when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) > F.size(b), differ(folded(a), b)).otherwise(differ(a, folded(b)))
    return 9 * least <= n + m


def _mark(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A Bloom filter of fixed size over ids (one long column): a sieve only, so its errors cost time alone."""

    def run(batches):
        have = np.zeros(1 << bits, bool)
        seen = False
        for batch in batches:
            for salt in (1, 2):
                have[(mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64), salt) >> np.uint64(64 - bits)).astype(np.int64)] = True
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(have).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << (bits - 3), np.uint8)
    for row in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return total


def _marked(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    keys = ids.cast(pa.int64()).fill_null(0).to_numpy().view(np.uint64)
    hit = np.ones(len(keys), bool)
    for salt in (1, 2):
        at = (mix(keys, salt) >> np.uint64(40)).astype(np.int64)
        hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in `gone` (one long column). A filter of fixed size lets most rows
    pass where they are; only rows that it has meet the exact ids."""
    gone = gone.toDF("__gone").distinct()
    shipped, place = docs.sparkSession.sparkContext.broadcast(_mark(gone)), docs.columns.index(id_col)

    def keep(wanted: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(_marked(shipped.value, batch.column(place)) == wanted))

        return run

    clear, suspect = (docs.mapInArrow(keep(w), docs.schema) for w in (False, True))
    return clear.union(suspect.join(gone.hint("merge"), suspect[id_col] == gone["__gone"], "left_anti"))


def _sets_for(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the sets in `wanted` (node, doc_id of a document that has it); texts are not moved."""
    shipped = docs.sparkSession.sparkContext.broadcast(_mark(wanted.select(F.coalesce("doc_id", F.lit(0).cast("long")))))

    def run(batches):
        for batch in batches:
            hit = _marked(shipped.value, batch.column(0))
            sets = list(_each(batch.filter(pa.array(hit)).column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), _long_lists([_longs(s) for s in sets])], schema=pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))]))

    found = docs.mapInArrow(run, "node bigint, shingles array<bigint>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _short_pairs(lists: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) within short lists that pass the bounds."""
    members = lists.where(F.col("c") <= SMALL_LIST).select("key", "node").join(maps, "node").select("key", "node", "n", "map")
    left, right = members.toDF("key", "a", "n1", "m1"), members.toDF("key", "b", "n2", "m2")
    fits = _size_fits(F.col("n1"), F.col("n2")) & _maps_fit(F.col("m1"), F.col("m2"), F.col("n1"), F.col("n2"))
    return left.join(right, "key").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * shared >= 80 * (len(a) + len(b) - shared)


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of `left` and `right` (places in `sets`): enough to give the components of
    all such links. `part`: a number for each place, equal where links are known already. Nearest pairs are tried first."""
    part, out, same = part.copy(), [], np.array_equal(left, right)
    size = np.array([len(x) for x in sets])
    maps = Maps([parity_map(x) for x in sets])
    for k in left.tolist():
        near = right[(part[right] != part[k]) & ((right > k) | (not same)) & (5 * np.minimum(size[right], size[k]) >= 4 * np.maximum(size[right], size[k]))]
        differ = maps.differences(k, near)
        fits = 9 * differ <= size[near] + size[k]
        near = near[fits][np.argsort(differ[fits], kind="stable")]
        while len(near):
            other, near = near[0], near[1:]
            if similar(sets[k], sets[other]):
                out.append((k, int(other)))
                part[part == part[other]] = part[k]
                near = near[part[near] != part[k]]
    return out


def _linked(members: DataFrame, payload: DataFrame, columns: list[str], compare, name: str) -> DataFrame:
    """Links (a, b) within lists or clusters (key, node), forests only. payload: node and the columns that
    compare(rows, left, right, part) needs; it gives pairs of places."""

    def found(rows: pa.Table) -> pa.Table:
        side, labels = rows.column("side").to_numpy(), rows.column("label").to_numpy()
        left, right = (np.flatnonzero((side == k) | (side == 2)) for k in (0, 1))
        pairs = compare(rows, left, right, np.unique(labels, return_inverse=True)[1])
        node = rows.column("node").to_numpy()
        a, b = (np.array([node[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    def compared(dealt: DataFrame) -> DataFrame:
        """dealt: key, i, j, side (0 left, 1 right, 2 both), node, label and the columns."""
        return dealt.select("key", "i", "j", "side", "node", "label", *columns).groupBy("key", "i", "j").applyInArrow(found, "a bigint, b bigint")

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("count"))
    placed = members.join(sizes, "key").join(payload, "node")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("count").cast("long")).cast("int")).withColumn("label", F.col("node"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # each block with each, or the first with each
    all_ = placed.where(F.col("count") <= FEW).select("*", upto("count").alias("other"))
    first = placed.where((F.col("count") > FEW) & (F.col("own") == 0)).select("*", upto("count").alias("other"))
    others = placed.where((F.col("count") > FEW) & (F.col("own") > 0)).withColumn("other", F.lit(0))
    dealt = all_.unionByName(first).unionByName(others).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("own") == F.col("i"), 0).otherwise(1)
    links = table(compared(dealt.withColumn("side", side)), name)
    big = sizes.where(F.col("count") > FEW)
    if not big.take(1):
        return links
    labels = table(components(links, name), name)
    large = members.join(big, "key").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    large = table(large.select("key", "node", "count", "label"), name)
    main = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = table(large.join(main, "key").where(F.col("label") != F.col("main")).select("key", "node", "count", "label"), name)
    left_over = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    left = rest.join(left_over, "key").join(payload, "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")).select("*", upto("count").alias("j"), F.lit(0).alias("side"))
    right = large.join(left_over, "key").join(payload, "node").withColumn("j", F.pmod(F.xxhash64("node"), F.col("count").cast("long")).cast("int")).select("*", upto("parts").alias("i"), F.lit(1).alias("side"))
    order = ["key", "i", "j", "side", "node", "label", *columns]
    return links.unionByName(table(compared(left.select(order).unionByName(right.select(order))), name))


def map_forest(maps: Maps, size: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of `left` and `right` (places) that the maps allow: a spanning forest."""
    part, out, same = part.copy(), [], np.array_equal(left, right)
    for k in left.tolist():
        rest = right[(part[right] != part[k]) & ((right > k) | (not same)) & (5 * np.minimum(size[right], size[k]) >= 4 * np.maximum(size[right], size[k]))]
        for other in rest[9 * maps.differences(k, rest) <= size[rest] + size[k]].tolist():
            if part[other] != part[k]:
                out.append((k, other))
                part[part == part[other]] = part[k]
    return out


def _split(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists of longs as arrays."""
    lists = column.combine_chunks()
    flat, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _long_pairs(lists: DataFrame, maps: DataFrame) -> DataFrame:
    """Candidate links (a, b) within long lists, forests only."""
    compare = lambda rows, left, right, part: map_forest(Maps(_split(rows.column("map"))), rows.column("n").to_numpy(), left, right, part)
    return _linked(lists.where(F.col("c") > SMALL_LIST).select("key", "node"), maps, ["n", "map"], compare, "join-long").distinct()


def _true_links(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within clusters (key, node), forests only, by whole sets (node, shingles)."""
    compare = lambda rows, left, right, part: forest(_split(rows.column("shingles")), left, right, part)
    return _linked(clusters, sets, ["shingles"], compare, "join-links")


def linked_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = shingle_counts(docs.select("text"), width)
    sets = table(described_sets(docs, counts, width).withColumn("row", F.monotonically_increasing_id()), "join-described")
    some = sets.where(F.col("n") > 0)
    classes = table(some.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct("row", "doc_id")).alias("first"), F.min("doc_id").alias("least")).select("node", "n", "first.*", "least"), "join-classes")
    leads = sets.where("lead").select("node", "n", "prefix", "load", "map")
    maps = leads.dropDuplicates(["node"]).select("node", "map", "n")

    listed = postings(leads, boundary_of(leads)).repartition("key").dropDuplicates(["key", "node"])
    heads = listed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.hash("node").cast("long")).alias("s1"), F.bit_xor(F.xxhash64("node")).alias("s2"))
    kept = heads.where(F.col("c") > 1).groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key", "c")
    lists = table(listed.join(kept, "key"), "join-lists")
    pairs = table(_short_pairs(lists, maps).unionByName(_long_pairs(lists, maps)), "join-pairs")
    clusters = table(components(pairs, "join-clusters").withColumnRenamed("component", "key"), "join-clusters")
    wanted = classes.select("node", "doc_id").join(clusters.select("node"), "node", "left_semi")
    whole = table(_sets_for(docs, wanted, width), "join-sets")
    found = components(_true_links(clusters, whole), "join-components")
    drop(whole)

    label = F.coalesce("component", "node")
    labels = classes.select("node", "least").join(found, "node", "left").select("node", label.alias("label"), "least")
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    named = some.select("doc_id", "n", "node").join(table(labels.join(least, "label").select("node", "component_id"), "join-named"), "node")
    blank = sets.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))  # linked with nothing
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(blank)
