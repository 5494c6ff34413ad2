"""Ogg containers: pages, packets, logical streams and time stamps.

`mux` writes logical streams of packets as pages; `demux` verifies every page's checksum and
sequence number, puts packets together from lacing values, also across pages, keeps the logical
streams apart and gives each packet the granule position at its end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import quoted, small_batches

CONTINUED, FIRST, LAST = 1, 2, 4
FRAME, RATE, PAGE_PACKETS = 576, 8000, 85
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, highest bit first, no inversion. zlib's is the same
    polynomial with the bits of each byte and of the result in reverse, and inverted at both ends."""
    x = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


class DamagedPage(ValueError):
    """A page that is cut short, out of order or fails its checksum."""


@dataclass
class Writer:
    """One logical stream; `packets` gives its pages."""

    serial: int
    sequence: int = 0
    granule: int = 0

    def page(self, lacing: bytes, body: bytes, flags: int, granule: int) -> bytes:
        head = _HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(lacing)) + lacing
        self.sequence += 1
        sum_ = crc(head + body)
        return head[:22] + sum_.to_bytes(4, "little") + head[26:] + body

    def packets(self, packets: list[bytes], spans: list[int], first: bool = False, last: bool = False, per_page: int = PAGE_PACKETS) -> Iterable[bytes]:
        """Pages of up to `per_page` packets; each packet lasts as many granules as `spans` says. A packet
        that needs over 255 lacing values goes on in the next page."""
        for a in range(0, len(packets), per_page):
            part = packets[a : a + per_page]
            lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in part)
            body, end, at, done = b"".join(part), a + len(part) >= len(packets), 0, 0
            sizes = spans[a : a + per_page]
            for b in range(0, len(lacing), 255):
                cut = lacing[b : b + 255]
                n = sum(cut)
                complete = len(cut) - cut.count(255)
                self.granule += sum(sizes[done : done + complete])
                done += complete
                flags = CONTINUED * (b > 0 and lacing[b - 1] == 255) | FIRST * (first and a == b == 0) | LAST * (last and end and b + 255 >= len(lacing))
                yield self.page(cut, body[at : at + n], flags, self.granule if complete else -1)
                at += n


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)  # of the page's last whole packet; None for those before it
    pages: int = 0
    sequence: int = 0
    rest: list[bytes] = field(default_factory=list)
    ended: bool = False


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file, by serial number, in order of appearance."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise DamagedPage(f"cut short at {at}")
        magic, version, flags, granule, serial, sequence, sum_, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise DamagedPage(f"no page at {at}")
        lacing = np.frombuffer(data, np.uint8, min(n, len(data) - at - 27), at + 27)
        ends = np.cumsum(lacing, dtype=np.int64)
        body = at + 27 + n
        end = body + (int(ends[-1]) if n else 0)
        if end > len(data) or len(lacing) < n:
            raise DamagedPage(f"cut short at {at}")
        if crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != sum_:
            raise DamagedPage(f"checksum at {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                raise DamagedPage(f"stream {serial} has no first page")
            s = streams[serial] = Stream(serial)
        if sequence != s.sequence or bool(flags & CONTINUED) != bool(s.rest) or s.ended:
            raise DamagedPage(f"page {sequence} of stream {serial} is out of order")
        s.sequence, s.pages, s.ended = sequence + 1, s.pages + 1, bool(flags & LAST)
        stops = np.flatnonzero(lacing < 255)
        cuts = [0, *ends[stops].tolist()]
        whole = [data[body + x : body + y] for x, y in zip(cuts, cuts[1:], strict=False)]
        if s.rest and whole:
            whole[0] = b"".join([*s.rest, whole[0]])
            s.rest = []
        if body + cuts[-1] < end:
            s.rest.append(data[body + cuts[-1] : end])
        s.packets += whole
        s.granules += [None] * (len(whole) - 1) + [granule] if whole else []
        at = end
    for s in streams.values():
        if s.rest or not s.ended:
            raise DamagedPage(f"stream {s.serial} has no last page")
    return streams


def times(stream: Stream, spans: list[int], rate: int) -> np.ndarray:
    """Seconds at which each packet begins: granule positions, carried back over packets within a page."""
    start = np.zeros(len(spans))
    at: int | None = None
    for k in range(len(spans) - 1, -1, -1):
        at = stream.granules[k] if stream.granules[k] is not None else at
        at -= spans[k]
        start[k] = at / rate
    return start


def store(payload: bytes, n_bytes: int) -> bytes:
    """Samples of 8 bits as an Ogg file: a stream of PCM packets of FRAME samples and one of levels, a packet for each second page."""
    tag = zlib.crc32(payload)
    pcm, level = Writer(tag), Writer(tag ^ 0x5A5A5A5A)
    head = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, FRAME, 1)
    out = [*pcm.packets([head], [0], first=True), *level.packets([b"LEVEL\0\0\0" + struct.pack(">I", RATE)], [0], first=True)]
    out += pcm.packets([b"n_bytes=%d" % n_bytes], [0])
    frames = [payload[a : a + FRAME] for a in range(0, len(payload), FRAME)]
    sums = np.abs(np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16) - 128).sum(axis=1, dtype=np.int64)
    for a in range(0, len(frames), PAGE_PACKETS):
        part, end = frames[a : a + PAGE_PACKETS], a + PAGE_PACKETS >= len(frames)
        out += pcm.packets(part, [FRAME] * len(part), last=end)
        out += level.packets([struct.pack(">Q", int(sums[a : a + PAGE_PACKETS].sum()))], [FRAME * len(part)], last=end)
    return b"".join(out)


def read(media: bytes) -> dict:
    """The samples and what the streams say about them."""
    pcm, level = demux(media).values()
    if pcm.packets[0][:8] != b"PCM     " or level.packets[0][:5] != b"LEVEL":
        raise DamagedPage("unknown streams")
    rate = struct.unpack_from(">I", pcm.packets[0], 16)[0]
    frames = pcm.packets[2:]
    spans = [0, 0, *map(len, frames)]
    start = times(pcm, spans, rate)
    return {
        "payload": b"".join(frames),
        "n_bytes": int(pcm.packets[1][8:]),
        "seconds": (pcm.granules[-1] or 0) / rate,
        "last_start": float(start[-1]),
        "level": sum(struct.unpack(">Q", p)[0] for p in level.packets[1:]),
        "n_packets": len(frames),
        "n_pages": pcm.pages + level.pages,
    }


def feature(sound: dict) -> str:
    """Mean level, spread, sign changes, duration and eight shares of the sample values."""
    x = np.frombuffer(sound["payload"], np.uint8)
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    y = x.astype(np.int16) - 128
    changes = int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))
    return f"level={sound['level'] / len(x):.4f};spread={y.std(dtype=np.float64):.4f};changes={changes};seconds={sound['seconds']:.4f};last={sound['last_start']:.4f};shares={','.join(f'{s:.4f}' for s in shares)}"


def store_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, media): every whole text as an Ogg file.

    The UTF-8 bytes (null: none) are filled with bytes 255 up to a positive multiple of FRAME. Equal
    texts give equal files, repeated and null ids (whole numbers) stay rows of their own, an empty table gives none.
    """

    def run(batches):
        for b in small_batches(batches):
            ids, texts, out, held, a = b.column(0), b.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                raw = (t or "").encode("utf-8", "replace")
                out.append(store(raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\xff"), len(raw)))
                held += len(raw)
                if held > 4 << 20 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(a, len(out)), pa.array(out, pa.binary())], ["doc_id", "media"])
                    a, out, held = i + 1, [], 0

    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("x")).mapInArrow(run, "doc_id long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_pages long, seconds double"


def read_media(stored: DataFrame) -> DataFrame:
    """What reading the files back gives: digests of the samples and of the file, and the feature. A null file gives nulls; a damaged one is an error."""

    def one(media: bytes | None) -> list:
        if media is None:
            return [None] * 10
        s = read(media)
        p = s["payload"]
        return [s["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s["n_packets"], s["n_pages"], s["seconds"]]

    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in READ.split(", ")])

    def run(batches):
        for b in small_batches(batches, 100):
            rows = [one(m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema.names)

    return stored.select("doc_id", "media").mapInArrow(run, READ)
