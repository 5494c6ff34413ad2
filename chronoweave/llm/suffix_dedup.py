"""Suffix-array dedup: bytes of strings of WINDOW bytes that also start earlier are removed.

1. Every window of WINDOW bytes has a key, the least hash of its K-byte substrings. Equal windows
   have equal keys, so windows whose key is met once are settled; runs of windows with one key form
   a segment. Only segments of keys met again go on, and equal segments go on once.
2. Segments of a key are cut into shards. Each shard's Burrows-Wheeler transform comes from its own
   suffix array. The shards are merged by refining an interleave: at first the shards' rows one
   after another; each round sorts the rows, without changing the order of equals, by the letters
   before them and steps to the rows of those letters, so after depth h rows lie together exactly
   if their first h letters are equal. A letter here is STEP bytes. Rows that are alone are settled
   and leave. Rows still together at depth WINDOW have a common prefix of WINDOW: a repeated interval.
3. In each repeated interval all but the first start, by document id and place, are repeats.
   A document's repeats are joined and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, quoted, small_batches, written
from .words import _powers, mix

WINDOW, K, STEP = 100, 20, 8
CHUNK, SHARDS, BLOCK_BYTES = 1 << 19, 4, 1 << 20


def _pieces(offsets: np.ndarray, size: int = 1 << 19):
    """Slices of rows of about `size` bytes."""
    a = 0
    while a < len(offsets) - 1:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, z
        a = z


def _sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """f over each n neighbours of x."""
    w, out = 1, x
    while 2 * w <= n:
        out = f(out[:-w], out[w:])
        w *= 2
    return f(out[: len(out) - (n - w)], out[n - w :]) if w < n else out


def runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = K):
    """Runs of windows of equal key: (row, start in the row, number of windows, key, whether a window may repeat inside)."""
    span, n = window - k + 1, len(data)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _sliding(np.minimum, h, span)  # one for each window
    length = np.diff(offsets)
    first, last = offsets[:-1][length >= window], offsets[1:][length >= window] - window
    cut = np.zeros(len(least) + 1, bool)
    cut[1:-1] = least[1:] != least[:-1]
    cut[first] = True
    cut[last + 1] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(least))
    row = np.searchsorted(offsets, starts, side="right") - 1
    ok = (starts < len(least)) & (starts <= offsets[row + 1] - window)
    starts, ends, row = starts[ok], ends[ok], row[ok]
    # a least hash at two places at most a span apart: a window may repeat in its own run (at just a span, as the next window holds the second)
    most = _sliding(np.maximum, np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span)
    place = np.flatnonzero(most == h)
    twin = place[:-1][(h[place[1:]] == h[place[:-1]]) & (place[1:] - place[:-1] <= span)]
    inside = np.zeros(len(starts), bool)
    if len(twin) and len(starts):
        of = np.searchsorted(offsets, twin, side="right") - 1
        at = np.searchsorted(starts, np.minimum(twin, offsets[of + 1] - window), side="right") - 1
        inside[np.maximum(at, 0)] = True
    return row, starts - offsets[row], ends - starts, least[starts], inside


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from .common import bytes_of

    return bytes_of(column)


def _run_rows(batches, counts_only: bool):
    for b in small_batches(batches):
        data, offsets = _bytes(b.column(1))
        docs = b.column(0).to_numpy(zero_copy_only=False)
        for a, z in _pieces(offsets):
            row, start, n, key, inside = runs(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            key = pa.array(key.view(np.int64))
            if counts_only:
                yield pa.RecordBatch.from_arrays([key, pa.array(1 + inside.astype(np.int64))], ["key", "w"])
            else:
                yield pa.RecordBatch.from_arrays([key, pa.array(docs[a:z][row]), pa.array(start.astype(np.int32)), pa.array(np.where(inside, -n, n).astype(np.int32))], ["key", "doc", "start", "n"])


def _digest(part: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(part, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _segments(batches):
    """Of rows (doc, text, runs): (key, a, b, doc, start, n, inside, segment); n is the segment's length, inside whether a window may repeat in it."""
    names = ["key", "a", "b", "doc", "start", "n", "inside", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for b in small_batches(batches):
        rows: list[tuple] = []
        for doc, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = text.encode("utf-8", "replace")
            for f in found:
                s = raw[f["start"] : f["start"] + abs(f["n"]) + WINDOW - 1]
                rows.append((f["key"], *_digest(s), doc, f["start"], len(s), f["n"] < 0, s))
        for x in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[x : x + 20_000], strict=True), kinds, strict=True)], names)


def _order(rank: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks (all under `top`) in order and their places. Rank and place in one integer sort faster than places by rank."""
    bits = max(1, len(rank) - 1).bit_length()
    if top.bit_length() + bits > 63:
        order = np.argsort(rank, kind="stable")
        return rank[order], order
    both = np.sort(rank << bits | np.arange(len(rank)))
    return both >> bits, both & ((1 << bits) - 1)


def suffix_order(follow: np.ndarray, ahead: np.ndarray, step: int, longest: int) -> np.ndarray:
    """The suffix array of circular strings by prefix doubling: `follow` ranks the first `step` letters, `ahead` is the place `step` on."""
    n = len(follow)
    rank, h, top = follow.astype(np.int64), step, int(follow.max()) + 1
    while True:
        ranked, order = _order(rank, top)
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if new[order[-1]] == n - 1 or h > longest:
            return order
        rank, top = new * n + new[ahead], n * n
        ahead = ahead[ahead]
        h *= 2


def _ranks(x: np.ndarray, top: int) -> np.ndarray:
    """Dense ranks of numbers under `top`."""
    ranked, order = _order(x, top)
    out = np.empty(len(x), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return out


def merge_shards(parts: list[bytes], window: int = WINDOW, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of distinct strings: (string, start, interval), rows of one interval being equal windows."""
    size = np.array([len(p) + 1 for p in parts])
    base = np.concatenate([[0], np.cumsum(size)])
    n = int(base[-1])
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    back = np.arange(-1, n - 1, dtype=np.int32)
    back[base[:-1]] = base[1:] - 1
    one = text[back].astype(np.int64)  # letters before each place
    back2 = back[back]
    two = one[back] << 8 | one
    back4 = back2[back2]
    letter4 = _ranks(two[back2] << 16 | two, 1 << 32)
    back8 = back4[back4]
    letter8 = _ranks(letter4[back4] * n + letter4, n * n)
    ahead8 = np.empty(n, np.int32)
    ahead8[back8] = np.arange(n, dtype=np.int32)
    # each shard's suffix array gives its rows: the letter before a row and the row of that letter
    bounds = base[np.linspace(0, len(parts), min(shards, len(parts)) + 1).astype(int)]
    places = np.empty(n, np.int32)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        places[s:e] = s + suffix_order(letter8[ahead8[s:e]], ahead8[s:e] - s, STEP, int(size.max()))
    row_of = np.empty(n, np.int32)
    row_of[places] = np.arange(n, dtype=np.int32)
    steps = [(letter8[places], row_of[back8[places]])] * (window // STEP)
    if window % STEP:
        assert window % STEP == 4
        steps.append((letter4[places], row_of[back4[places]]))
    # the places that a window lies before
    offset = places - base[owner[places]]
    rows = np.flatnonzero(offset >= window).astype(np.int64)
    block = np.zeros(len(rows), np.int64)
    for letters, before in steps:
        key = np.sort(letters[rows].astype(np.int64) << 32 | np.arange(len(rows)))
        order = key & 0xFFFFFFFF
        letter, block = key >> 32, block[order]
        rows = before[rows[order]].astype(np.int64)
        edge = np.ones(len(rows) + 1, bool)
        edge[1:-1] = (letter[1:] != letter[:-1]) | (block[1:] != block[:-1])
        alone = edge[1:] & edge[:-1]
        block = np.cumsum(edge[:-1])[~alone]
        rows = rows[~alone]
        if not len(rows):
            break
    at = places[rows]
    return owner[at].astype(np.int64), at - base[owner[at]], block


def repeats(parts: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to): ranges of starts in each string whose windows start earlier elsewhere."""
    string, at, block = merge_shards(parts, window)
    if not len(string):
        return string, at, at
    place = starts[string] + at
    order = np.lexsort((place, docs[string], block))
    string, at, block = string[order], at[order], block[order]
    later = np.concatenate([[False], block[1:] == block[:-1]])
    string, at = string[later], at[later]
    order = np.lexsort((at, string))
    string, at = string[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (string[1:] != string[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return string[first], at[first], at[np.append(first[1:], len(at)) - 1]


def _merge(batches):
    """Of rows (key, x, y, doc, start, segment) in order of the first three: ranges (doc, from, to) of bytes to remove."""
    names = ["doc", "from", "to"]

    def chunk(held):
        # a block pair may hold a block alone; keys never share a window
        docs, starts, parts = (list(c) for c in zip(*held, strict=True))
        docs, starts = np.array(docs, np.int64), np.array(starts, np.int64)
        string, a, z = repeats(parts, docs, starts)
        return pa.RecordBatch.from_arrays([pa.array(docs[string]), pa.array(starts[string] + a), pa.array(starts[string] + z + WINDOW)], names)

    key, held, size = None, [], 0
    for b in small_batches(batches):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            # a new chunk begins with a new key, so all of a key's windows are in one; those of two blocks may be met twice, apart
            if row[:3] != key:
                if size >= CHUNK or (key is not None and row[0] == key[0]):
                    yield chunk(held)
                    held, size = [], 0
                key = row[:3]
            held.append(row[3:])
            size += len(row[5])
    if held:
        yield chunk(held)


OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of maximal runs of them."""
    kept, at, removed, n = [], 0, 0, 0
    end = -1
    for a, z in sorted(spans):
        if a > end:
            n += 1
        elif z <= end:
            continue
        a = max(a, end)
        kept.append(raw[at:a])
        removed += z - a
        at = end = z
    kept.append(raw[at:])
    return b"".join(kept), removed, n


def _finish(batches, with_text: bool):
    names = [f.split()[0] for f in OUT.split(", ")] + (["kept"] if with_text else [])
    for b in small_batches(batches):
        rows = []
        for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            left, removed, n = cut_out(raw, [(s["from"], s["to"]) for s in spans or ()])
            rows.append((doc, len(raw), removed, n, hashlib.sha256(left).hexdigest(), left)[: len(names)])
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): each document without the bytes covered by a string of
    WINDOW bytes that also starts earlier, in a document of smaller id or further up in the same one.

    Matches never cross documents and are judged on the input. Null text is empty. Of documents with
    equal ids, the one whose text sorts first is earlier; a null id is smaller than any. Texts under
    WINDOW bytes stay whole. Ids are whole numbers. Only the two columns named are read; an empty table gives none.

    A merging task holds two blocks of BLOCK_BYTES and at most one segment more of each, which a document bounds.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("id"), quoted(text).alias("text"))
    named = None
    if not rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        # ids that aren't unique are replaced by places in the order of (id, text)
        rows = written(rows.orderBy(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("doc", F.monotonically_increasing_id()), "placed")
        named, rows = rows.select("doc", "id"), rows.select(F.col("doc").alias("id"), "text")
    full = rows.where(f"octet_length(text) >= {WINDOW}")
    again = full.mapInArrow(lambda b: _run_rows(b, True), "key long, w long").groupBy("key").agg(F.sum("w").alias("w")).where("w > 1").select("key")
    again = written(again, "keys-met-again")
    found = full.mapInArrow(lambda b: _run_rows(b, False), "key long, doc long, start int, n int").join(again, "key")
    found = written(found, "runs-met-again")
    discard(again)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))
    cut = full.select(F.col("id").alias("doc"), "text").join(by_doc, "doc").select("doc", "text", "runs")
    cut = written(cut.mapInArrow(_segments, "key long, a long, b long, doc long, start int, n int, inside boolean, segment binary"), "segments", "zstd")
    discard(found)
    # of equal segments the first goes on, the others are repeats as a whole
    same = ["key", "a", "b"]
    firsts = cut.groupBy(*same).agg(F.min(F.struct("doc", "start", "segment")).alias("f"), F.max("inside").alias("inside"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts.select(*same, "f.doc", "f.start", "f.segment", "inside", "copies"), "first-segments", "zstd")
    many = firsts.where("copies > 1").select(*same, F.col("doc").alias("d"), F.col("start").alias("s"))
    copies = cut.select(*same, "doc", "start", "n").join(many, same).where("doc <> d or start <> s")
    copies = copies.select("doc", F.col("start").cast("long").alias("from"), (F.col("start") + F.col("n")).cast("long").alias("to"))
    # a key of one segment has nothing to merge; one of more bytes than a block is a task for each two blocks of them
    plain = firsts.select("key", "doc", F.col("start").cast("long").alias("start"), "segment", "inside", "a")
    large = firsts.groupBy("key").agg(F.ceil(F.sum(F.octet_length("segment")) / F.lit(BLOCK_BYTES)).cast("int").alias("m")).where("m > 1")
    large = written(large, "large-keys")
    some = not large.isEmpty()
    rest = plain.join(large, "key", "left_anti") if some else plain
    of_key = Window.partitionBy("key")
    rest = rest.withColumn("c", F.count(F.lit(1)).over(of_key)).withColumn("any", F.max("inside").over(of_key)).where("c > 1 or any")
    none = F.lit(0)
    ranges = rest.select("key", none.alias("x"), none.alias("y"), "doc", "start", "segment").mapInArrow(_merge, "doc long, from long, to long")
    if some:
        i = F.pmod(F.xxhash64("a"), F.col("m")).cast("int")
        ones = plain.join(large, "key").withColumn("i", i).withColumn("o", F.explode(F.sequence(none, F.col("m") - 1)))
        pairs = ones.select("key", F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"), "doc", "start", "segment")
        pairs = pairs.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        ranges = ranges.union(pairs.mapInArrow(_merge, "doc long, from long, to long"))
    ranges = written(copies.union(ranges), "ranges")
    discard(cut)
    discard(firsts)
    spans = ranges.groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    last = rows.select(F.col("id").alias("doc"), "text").join(spans, "doc", "left").select("doc", "text", "spans")
    out = last.mapInArrow(lambda b: _finish(b, with_text), OUT + (", kept binary" if with_text else ""))
    if named is not None:
        out = out.join(named, "doc").drop("doc").withColumnRenamed("id", "doc")
    cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    return out.select(F.col("doc").alias("doc_id"), *cols)
