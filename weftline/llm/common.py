"""What the operators of this subpackage share: the word pattern, stable hashes, shared tables and
vectorised hashing of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.scratch import drop, table  # noqa: F401  (what the operators write between their steps)

#: A word: a run of bytes other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_text(column: Column) -> Column:
    """An id as text; null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(modulus))


def unit_bits(seed: str, *columns: Column) -> Column:
    """52 seeded, evenly spread bits for the values, as long; the same in any engine with md5."""
    joined = F.concat_ws(":", F.lit(seed), *[id_text(c) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("long")


# ---------------------------------------------------------------- batches of texts

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[i] = sum of value(data[j]) * base**j over j < i; range_hash() reads ranges from it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end, wherever the range lies."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def words_of(texts: list[bytes], drop: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased and the bytes in `drop` left out,
    and offsets: text i has the words offsets[i] to offsets[i + 1]."""
    clean = [t.translate(_LOWER, drop) for t in texts]
    data = np.frombuffer(b"\n".join([*clean, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum([len(c) + 1 for c in clean])
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    hashes = mix(range_hash(prefix_hash(data), start, end))
    offsets = np.concatenate([[0], np.searchsorted(start, ends, "left")])
    return hashes, offsets


def blocks(values: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts of a list of byte strings into runs of about `limit` bytes; a longer string stands alone."""
    first, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield first, i
            first, held = i, 0
        held += len(v)
    if first < len(values):
        yield first, len(values)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null as empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
