"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask picks some of a run of words and ignores the rest, so a run with substituted words
at ignored places keeps its hash. Hashes of the benchmark are joined to those of the documents;
around each hit the two texts are laid over each other word by word, and the run of highest score
(a match 1, a substitution -1) is the overlap. An overlap counts if it has at least MATCHES equal
words and COVER of the item, or RUN equal words one after another, whatever share of the item they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, place, quoted, renamed, small_batches
from .words import GOLD, chunks, mix, word_hashes

#: The last one finds every MATCHES equal words in a row.
MASKS = ("110110011", "101110101", "111001011", "1101010011", "11111111")
COVER, MATCHES, RUN, BLOCK_BYTES = 0.5, 8, 13, 32 << 20
#: Bounds of what is looked at in one go: hits of seeds, and cells of hits by words.
HITS, CELLS = 1 << 19, 1 << 21
OUT = "doc_id long, item_id long, matches long, overlap long, item_words long, doc_start long, item_start long"


def _seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(salt + 1))
    for k, c in enumerate(mask):
        if c == "1":
            h = h * GOLD + words[k : k + n]
    return mix(h)


class Index:
    """Seed hashes of benchmark items, sorted, behind a bitmap."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words, self.offsets = word_hashes([t for _, t in items])
        count = np.diff(self.offsets)
        span = max(map(len, masks))
        # an item too short for a mask is one run of all its words
        self.masks = [*masks, *("1" * int(n) for n in np.unique(count[(count > 0) & (count < span)]))]
        hashes, item, place = [], [], []
        for m, mask in enumerate(self.masks):
            for i in range(len(items)):
                if m >= len(masks) and count[i] != len(mask):
                    continue
                h = _seeds(self.words[self.offsets[i] : self.offsets[i + 1]], mask, m)
                hashes.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        h, i, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], i[order], p[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def _hits(self, words: np.ndarray, offsets: np.ndarray):
        """(text, item, place of the item's start among the words) of seeds in common, HITS at most at a time."""
        found = []
        for m, mask in enumerate(self.masks):
            h = _seeds(words, mask, m)
            p = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[p], "left"), np.searchsorted(self.hashes, h[p], "right")
            found.append(np.stack([p, lo, hi])[:, hi > lo])
        p, lo, hi = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.argsort(p, kind="stable")
        p, lo, hi = p[order], lo[order], hi[order]
        ends = np.cumsum(hi - lo)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:
            # hits at to at + HITS, whichever seeds they are of
            a, z = np.searchsorted(ends, [at, min(at + HITS, total) - 1], side="right")
            k = np.arange(at, min(at + HITS, total))
            seed = a + np.searchsorted(ends[a : z + 1], k, side="right")
            entry = hi[seed] - (ends[seed] - k)
            hit = np.stack([np.searchsorted(offsets, p[seed], side="right") - 1, self.item[entry], p[seed] - self.place[entry]])
            yield np.unique(hit, axis=1)
            at += HITS

    def _best(self, hits: np.ndarray, words: np.ndarray, offsets: np.ndarray, cover: float, least: int) -> np.ndarray:
        """Of hits the best runs that count: text, item, matches, overlap, words of the item, start in the text, start in the item."""
        d, i, g = hits
        n = np.diff(self.offsets)[i]
        skip = np.maximum(0, offsets[d] - g)  # words of the item before the text
        width = np.minimum(n, offsets[d + 1] - g) - skip
        k = np.arange(int(width.max()))
        inside = k < width[:, None]
        at = np.where(inside, (g + skip)[:, None] + k, 0)
        same = inside & (words[at] == self.words[np.where(inside, (self.offsets[i] + skip)[:, None] + k, 0)])
        gain = np.where(inside, np.where(same, 1, -1), -(10**6)).astype(np.int32)
        total = np.zeros((len(d), len(k) + 1), np.int32)
        np.cumsum(gain, axis=1, out=total[:, 1:])
        low = np.minimum.accumulate(total[:, :-1], axis=1)
        end = np.argmax(total[:, 1:] - low, axis=1)
        row = np.arange(len(d))
        first = np.argmax((total[:, :-1] == low[row, end][:, None]) & (k <= end[:, None]), axis=1)
        hit = np.zeros((len(d), len(k) + 1), np.int32)
        np.cumsum(same, axis=1, out=hit[:, 1:])
        matches = hit[row, end + 1] - hit[row, first]
        run = (k - np.maximum.accumulate(np.where(same, -1, k), axis=1)).max(axis=1)
        ok = ((matches >= np.minimum(least, n)) & (matches >= cover * n)) | (run >= RUN)
        return np.stack([d, i, matches, end + 1 - first, n, g + skip + first - offsets[d], skip + first])[:, ok]

    def overlaps(self, texts: list[str | None], cover: float = COVER, least: int = MATCHES) -> list[np.ndarray]:
        """Arrays: text, item, matches, overlap, words of the item, start in the text, start in the item; the best of each pair."""
        words, offsets = word_hashes(texts)
        out = np.zeros((7, 0), np.int64)
        for hits in self._hits(words, offsets):
            # the widest first, so that a slice is as wide as its first
            d, i, g = hits
            width = np.minimum(np.diff(self.offsets)[i], offsets[d + 1] - g) - np.maximum(0, offsets[d] - g)
            hits, width = hits[:, np.argsort(-width, kind="stable")], np.sort(width)[::-1]
            rows, a = [out], 0
            while a < len(width):
                z = a + max(1, CELLS // int(width[a]))
                rows.append(self._best(hits[:, a:z], words, offsets, cover, least))
                a = z
            out = np.concatenate(rows, axis=1)
            out = out[:, np.lexsort((out[6], out[5], -out[2], out[1], out[0]))]
            new = np.ones(out.shape[1], bool)
            new[1:] = (out[0, 1:] != out[0, :-1]) | (out[1, 1:] != out[1, :-1])
            out = out[:, new]
        return list(out)


def _indexes(benchmark: DataFrame, text: str, item_id: str):
    """Indexes over all items, each of a bounded number of bytes; one for most benchmarks."""
    items = benchmark.select(quoted(item_id).cast("long").alias("i"), quoted(text).alias("t")).where("t is not null and i is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = int(-(-size // BLOCK_BYTES)) or 1
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield Index(sorted((r.i, r.t) for r in part.distinct().toLocalIterator()))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", cover: float = COVER, least: int = MATCHES) -> DataFrame:
    """One row for each document and item that overlap in at least `least` words and `cover` of the item, or in RUN words in a row.

    Ids are whole numbers. An item of fewer than `least` words must be whole. Null, empty and wordless texts overlap
    nothing; repeated documents each give their rows; items of equal id are one item of several
    texts. A null document id stays null. The benchmark is read in blocks of BLOCK_BYTES, each sent
    to the executors and joined to all documents, so what is broadcast is bounded.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("d"), quoted(text).alias("x"))
    spark, out = docs.sparkSession, None
    for index in _indexes(benchmark, text, item_id):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in small_batches(batches):
                ids, texts = b.column(0), b.column(1).to_pylist()
                for a, z in chunks(texts):
                    doc, item, *rest = index.overlaps(texts[a:z], cover, least)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + a)), pa.array(index.ids[item]), *(pa.array(x) for x in rest)], [x.split()[0] for x in OUT.split(", ")])

        part = rows.mapInArrow(run, OUT)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", cover: float = COVER, least: int = MATCHES) -> DataFrame:
    """`docs` without the rows that overlap an item as `contamination` has it; no shuffle. Null texts stay."""
    rows, names = renamed(docs)
    at = place(names, text)
    for index in _indexes(benchmark, text, item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in small_batches(batches):
                texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for a, z in chunks(texts):
                    keep[index.overlaps(texts[a:z], cover, least)[0] + a] = False
                yield b.filter(pa.array(keep))

        rows = rows.mapInArrow(run, fields(rows).rstrip(", "))
    return rows.toDF(*names)
