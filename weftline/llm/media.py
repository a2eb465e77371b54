"""Ogg columns: write, verify, demultiplex and describe.

write() lays packets of several logical streams into pages; demultiplex() reads any Ogg bytes: it
checks each page's checksum, puts packets together from the lacing values (a value of 255 goes on,
also across pages), separates the logical streams by serial number and derives times from granule
positions. Damaged or foreign bytes are skipped up to the next page and counted.

A text becomes two logical streams: its UTF-8 bytes as unsigned 8-bit samples, and a stream of
checksums of those samples, both with an identification packet first.

Defined results: null counts as the empty text; the payload is padded with bytes 0 to a positive
multiple of 64; equal texts give equal bytes. Texts of any length are handled one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8

RATE = 8000
PACKET = 4000  # samples in a packet
MARK_EVERY = 4  # sample packets for each packet of the checksum stream
PAGE_SEGMENTS = 40
SAMPLES, MARKS = 0x53414D50, 0x4D41524B  # serial numbers
CONTINUED, FIRST, LAST = 1, 2, 4

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, high bit first, start and end 0. Mirrored bits turn it into
    the common CRC-32, for which there is fast code."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    whole = bytearray(head + body)
    whole[22:26] = page_checksum(bytes(whole)).to_bytes(4, "little")
    return bytes(whole)


def pages_of(serial: int, packets: list[tuple[bytes, int]], segments: int = PAGE_SEGMENTS) -> list[bytes]:
    """The pages of one logical stream; packets with the granule position at their ends. The first
    packet has a page to itself, as identification."""
    out: list[bytes] = []
    lacing, body, granule, open_packet = bytearray(), [], -1, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, open_packet
        flags = CONTINUED * open_packet | FIRST * (not out) | LAST * last
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), b"".join(body)))
        lacing, body, granule = bytearray(), [], -1

    for i, (data, at) in enumerate(packets):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        done = 0
        for j, value in enumerate(values):
            lacing.append(value)
            body.append(data[done : done + value])
            done += value
            ends = j == len(values) - 1
            if ends:
                granule = at
            if len(lacing) == segments or ends and i == 0:
                close(ends and i == len(packets) - 1)
                open_packet = not ends
    if lacing:
        close(True)
    return out


def write(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """All identification pages first, then the streams' other pages in turn."""
    pages = [pages_of(serial, packets) for serial, packets in streams.items()]
    out = [p[0] for p in pages]
    rest = [p[1:] for p in pages]
    for i in range(max(map(len, rest), default=0)):
        out += [p[i] for p in rest if i < len(p)]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream as read: packets, and for each the granule position and number of the page it
    ended on (-1 where the page gives none)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    held: list[bytes] | None = None
    next_page: int = 0

    def seconds(self, rate: int) -> list[float]:
        """Times of the packets' ends."""
        return [g / rate if g >= 0 else float("nan") for g in self.granules]


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, and the number of bytes that belong to no sound page."""
    streams: dict[int, Stream] = {}
    at, lost = 0, 0
    while at < len(data):
        size = 0
        if data[at : at + 4] == b"OggS" and len(data) - at >= 27:
            _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
            lacing = data[at + 27 : at + 27 + n]
            whole = 27 + n + sum(lacing)
            if version == 0 and at + whole <= len(data) and page_checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : at + whole]))) == crc:
                size = whole
        if not size:
            found = data.find(b"OggS", at + 1)
            found = len(data) if found < 0 else found
            lost += found - at
            at = found
            continue
        s = streams.setdefault(serial, Stream())
        if s.pages and number != s.next_page:
            s.gaps += 1
            s.held = None
        s.pages, s.next_page, s.ended = s.pages + 1, number + 1, bool(flags & LAST)
        if not flags & CONTINUED:
            s.held = []
        elif s.held is None or number == 0:
            s.held = None  # the front of this packet is lost: skip to its end
        body, first = at + 27 + n, len(s.packets)
        for value in lacing:
            if s.held is not None:
                s.held.append(data[body : body + value])
            body += value
            if value < 255:
                if s.held is not None:
                    s.packets.append(b"".join(s.held))
                    s.granules.append(-1)
                s.held = []
        if len(s.packets) > first:
            s.granules[-1] = granule  # the position at the end of the last packet that ends here
        at += size
    return streams, lost


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or 64 * (not text))


def encode(data: bytes) -> bytes:
    """Bytes as an Ogg file of two streams."""
    samples = [(struct.pack("<8sIQ", b"PCMU8\0\0\1", RATE, len(data)), 0)]
    marks = [(struct.pack("<8sI", b"CRCMARK\1", RATE), 0)]
    for k, at in enumerate(range(0, len(data), PACKET)):
        end = min(len(data), at + PACKET)
        samples.append((data[at:end], end))
        if k % MARK_EVERY == MARK_EVERY - 1 or end == len(data):
            first = at - (k % MARK_EVERY) * PACKET
            marks.append((struct.pack("<QI", end, zlib.crc32(data[first:end])), end))
    return write({SAMPLES: samples, MARKS: marks})


def decode(media: bytes) -> tuple[bytes, dict]:
    """The samples of an Ogg file of encode(), and what reading it showed. Raises ValueError where
    the file is not whole."""
    streams, lost = demultiplex(media)
    if lost or SAMPLES not in streams or MARKS not in streams or any(s.gaps or not s.ended for s in streams.values()):
        raise ValueError(f"damaged Ogg file: {lost} bytes lost")
    sound, marks = streams[SAMPLES], streams[MARKS]
    _, rate, size = struct.unpack("<8sIQ", sound.packets[0])
    data = b"".join(sound.packets[1:])
    begin = 0
    for mark in marks.packets[1:]:
        end, crc = struct.unpack("<QI", mark)
        if zlib.crc32(data[begin:end]) != crc:
            raise ValueError("a checksum of the samples differs")
        begin = end
    if len(data) != size:
        raise ValueError("samples are missing")
    return data, {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "seconds": max(t for t in sound.seconds(rate) if t == t),
    }


def describe(data: bytes, read: dict) -> str:
    """Features of 8-bit samples, as text: streams, pages, packets, seconds, level, loudness, crossings."""
    x = np.frombuffer(data, np.uint8).astype(np.int16) - 128
    level, square = float(x.mean()), float((x.astype(np.int64) ** 2).mean())
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"streams={read['streams']};pages={read['pages']};packets={read['packets']};seconds={read['seconds']:.6f};mean={level:.4f};rms={square**0.5:.4f};crossings={crossings}"


SCHEMA = [
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
]


def media_features(docs: DataFrame, *, text_col: str = "text", with_media: bool = False) -> DataFrame:
    """`docs` without its text, with the columns of SCHEMA, and the Ogg bytes as `media` if asked for."""
    keep = [c for c in docs.columns if c != text_col]
    more = [*SCHEMA, T.StructField("media", T.BinaryType())] if with_media else SCHEMA
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: len(more)]

    def run(batches):
        for batch in batches:
            rows = []
            for text in utf8(batch.column(batch.num_columns - 1)):
                media = encode(payload(text))
                data, read = decode(media)
                row = (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(data, read), media)
                rows.append(row[: len(more)])
            new = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(more), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, *[f.name for f in more]])

    slim = docs.select(*keep, text_col)
    return slim.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *more]))
