"""Ogg media columns: a writer for lossless 8-bit samples and a reader of any Ogg bytes.

The reader resynchronises on the capture pattern, verifies every page's
checksum, rebuilds packets from lacing values (also across pages), keeps
logical streams apart by serial number and derives times from granule
positions. Broken or missing pages are counted and their packets left out.

Rows are independent: one map over the table, no shuffle. Memory per task is
one Arrow batch plus one media value.

Edge cases: a null or empty text becomes one packet of padding; repeated rows
give equal values; bytes that are no Ogg give no streams and one fault.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeleaf.llm.common import bounded_batches, stored, table

PACKET = 576
RATE = 8_000
STREAMS = 2
#: Of 576 bytes a packet takes three lacing values, so a page of 255 holds 85.
PACKETS_PER_PAGE = 255 // (PACKET // 255 + 1)
HEADER = struct.Struct("<4sBBqIIIB")
HEAD_MAGIC = b"U8PCM\0\0\0"
#: Bytes with their bits reversed: Ogg's checksum is the usual CRC-32 polynomial without reflection.
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> bytes:
    """The four checksum bytes of a page whose checksum field is zero."""
    return (zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF).to_bytes(4, "big").translate(MIRROR)


def page(serial: int, number: int, granule: int, body: bytes, lacing: bytes, flags: int) -> bytes:
    raw = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + checksum(raw) + raw[26:]


def pad(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of PACKET."""
    return data + b"\xff" * (-len(data) % PACKET if data else PACKET)


def encode(payload: bytes) -> bytes:
    """Samples as STREAMS logical streams that take packets in turn, their pages interleaved."""
    count = len(payload) // PACKET
    blocks = np.frombuffer(payload, np.uint8).reshape(count, PACKET)
    base = zlib.crc32(payload)
    serials = [(base + i) & 0xFFFFFFFF for i in range(STREAMS)]
    head = [HEAD_MAGIC + struct.pack("<IHHQ", RATE, i, STREAMS, len(payload)) for i in range(STREAMS)]
    out = [page(s, 0, 0, h, bytes([len(h)]), 2) for s, h in zip(serials, head, strict=True)]
    parts = [blocks[i::STREAMS] for i in range(STREAMS)]
    lacing = bytes([255] * (PACKET // 255) + [PACKET % 255])
    for n in range(max(1, -(-len(parts[0]) // PACKETS_PER_PAGE))):
        for serial, part in zip(serials, parts, strict=True):
            own = part[n * PACKETS_PER_PAGE : (n + 1) * PACKETS_PER_PAGE]
            done = min(len(part), (n + 1) * PACKETS_PER_PAGE)
            if len(own) or n == 0:
                out.append(page(serial, n + 1, done * PACKET, own.tobytes(), lacing * len(own), 4 if done == len(part) else 0))
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: (packets complete by the end of the page, granule position) of pages on which a packet ends.
    granules: list[tuple[int, int]] = field(default_factory=list)
    partial: list[bytes] | None = None
    next_page: int | None = None
    ended: bool = False

    def seconds(self, rate: int = RATE) -> float:
        return max((g for _, g in self.granules), default=0) / rate


def decode(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of faults: bad checksums, gaps and bytes between pages."""
    streams: dict[int, Stream] = {}
    at, faults = 0, 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + HEADER.size > len(data):
            found = data.find(b"OggS", at + 1)
            faults, at = faults + 1, len(data) if found < 0 else found
            continue
        _, version, flags, granule, serial, number, _, segments = HEADER.unpack_from(data, at)
        body = at + HEADER.size + segments
        lacing = data[at + HEADER.size : body]
        end = body + sum(lacing)
        raw = data[at:end]
        if version or end > len(data) or len(lacing) < segments or checksum(raw[:22] + bytes(4) + raw[26:]) != raw[22:26]:
            faults, at = faults + 1, at + 4
            continue
        at = end
        s = streams.setdefault(serial, Stream())
        if s.next_page is not None and number != s.next_page:
            faults, s.partial = faults + 1, None
        s.next_page, s.ended = number + 1, bool(flags & 4)
        skip = bool(flags & 1) and s.partial is None  # the packet's start is lost
        parts = s.partial if flags & 1 and s.partial is not None else []
        pos, ended = body, False
        for size in lacing:
            parts.append(data[pos : pos + size])
            pos += size
            if size < 255:
                if not skip:
                    s.packets.append(b"".join(parts))
                parts, skip, ended = [], False, True
        s.partial = parts if lacing and lacing[-1] == 255 and not skip else None
        if ended and granule >= 0:
            s.granules.append((len(s.packets), granule))
    return streams, faults


def samples(streams: dict[int, Stream]) -> bytes:
    """The payload that encode() stored: data packets in turn, streams in the order their heads name."""
    own = sorted((struct.unpack_from("<IHHQ", s.packets[0], len(HEAD_MAGIC))[1], s.packets[1:]) for s in streams.values() if s.packets and s.packets[0].startswith(HEAD_MAGIC))
    longest = max((len(p) for _, p in own), default=0)
    return b"".join(p[i] for i in range(longest) for _, p in own if i < len(p))


def feature(streams: dict[int, Stream], faults: int) -> str:
    """A short description: streams, packets, seconds, mean level, zero crossings around the middle, faults."""
    data = np.frombuffer(samples(streams), np.uint8)
    crossings = int(np.count_nonzero(np.diff(data >= 128)))
    seconds = sum(s.seconds() for s in streams.values())
    mean = int(data.sum(dtype=np.int64)) / max(1, len(data))
    return f"streams={len(streams)};packets={sum(len(s.packets) for s in streams.values())};seconds={seconds:.3f};mean={mean:.4f};crossings={crossings};faults={faults}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(text.as_py() or "").encode() for text in batch.column("text")]
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(list(map(len, raw)), pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes (of the text) and media, the text as an Ogg file."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, n_bytes long, media binary")


def media_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the stored files alone say."""
    for batch in batches:
        rows = []
        for value, n in zip(batch.column("media"), batch.column("n_bytes").to_pylist(), strict=True):
            media = value.as_py()
            streams, faults = decode(media)
            back = samples(streams)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(streams, faults)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(media_column(table(spark, sf_dir, "documents"))).mapInArrow(media_digests, SCHEMA)


def packets(media: DataFrame, key: str, column: str, rate: int = RATE) -> DataFrame:
    """One row per packet of an Ogg column: key, serial, packet, seconds (end of its page), data."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                streams, _ = decode(value.as_py() or b"")
                for serial, s in sorted(streams.items()):
                    ends = np.array([n for n, _ in s.granules] or [0])
                    at = np.searchsorted(ends, np.arange(len(s.packets)), side="right")
                    times = [s.granules[i][1] / rate if i < len(s.granules) else None for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(times)), pa.array([serial] * len(times), pa.int64()), pa.array(range(len(times)), pa.int32()), pa.array(times, pa.float64()), pa.array(s.packets, pa.binary())],
                        [key, "serial", "packet", "seconds", "data"],
                    )

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(explode, f"{key} {kind}, serial long, packet int, seconds double, data binary")
