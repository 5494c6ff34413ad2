"""N-gram Jaccard join with Bayesian candidate pruning over MinHash values.

1. Copies (equal word sequences) are grouped first; one representative of each goes on.
2. MinHash values in 32 bands of 5 give candidates: representatives that share a band key, over any
   chain, are one candidate cluster. A pair at similarity 0.8 shares none with probability 3e-6.
3. CHECKS further MinHash values are compared eight at a time; with m of n equal and a flat prior,
   the similarity has the posterior Beta(m + 1, n - m + 1), and a pair is dropped once its
   probability of reaching the threshold falls below TOLERANCE.
4. Clusters of more than BLOCK documents may be chains of documents that share little. They are cut
   first: only pairs that share a band key are compared, by their values alone, and what their
   surviving pairs connect are the new clusters.
5. Inside a cluster, in blocks, pairs are pruned and what is left is verified exactly on whole
   shingle sets. Tasks give counts of links and at most one edge per document, never the pairs.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, place, quoted, renamed, small_batches, written
from .words import chunks, mix, shingles, word_hashes

NGRAM, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, CHECKS, STEP = 32, 5, 128, 8
BLOCK, TILE = 1024, 512
_A = mix(np.arange(1, BANDS * ROWS + CHECKS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of n equal values with which the posterior probability of reaching the threshold is at least the tolerance."""
    for m in range(n + 1):
        if sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1)) >= tolerance:
            return m
    return n


def _signatures(runs: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least of each seed's hash over the runs of each text (texts x seeds, upper 32 bits); 0 for none."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, len(seeds)), np.uint32)
    if len(full):
        at = offsets[:-1][full]
        buffer = np.empty_like(runs)
        for k, a in enumerate(seeds):
            np.multiply(runs, a, out=buffer)
            out[full, k] = np.minimum.reduceat(buffer, at) >> np.uint64(32)
    return out


SIGNED = "doc_id long, digest binary, bands array<long>, checks binary"


def _sign(batches):
    for b in small_batches(batches):
        ids, texts = b.column(0), b.column(1).to_pylist()
        for a, z in chunks(texts):
            words, offsets = word_hashes(texts[a:z])
            runs, run_offsets = shingles(words, offsets, NGRAM)
            sig = _signatures(runs, run_offsets, _A)
            keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(sig), 0)
            for r in range(ROWS):
                keys = mix(keys * _A[r] + sig[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
            flat = pa.array(keys.view(np.int64).ravel())
            some = np.diff(offsets) > 0
            digest = [hashlib.blake2b(words[s:e], digest_size=16).digest() if e > s else None for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            checks = np.ascontiguousarray(sig[:, BANDS * ROWS :])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, z - a),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * BANDS, pa.int32()), flat),
                    pa.array([c.tobytes() if s else None for c, s in zip(checks, some, strict=True)], pa.binary()),
                ],
                ["doc_id", "digest", "bands", "checks"],
            )


def _pairs(sa: np.ndarray, sb: np.ndarray, same: bool, limits: dict[int, int]):
    """Index pairs of two blocks that Bayesian pruning leaves, tile by tile."""
    for a in range(0, len(sa), TILE):
        for b in range(a if same else 0, len(sb), TILE):
            x, y = sa[a : a + TILE], sb[b : b + TILE]
            m = np.zeros((len(x), len(y)), np.uint8)
            for k in range(STEP):
                m += x[:, k, None] == y[None, :, k]
            keep = m >= limits[STEP]
            if same and a == b:
                keep &= np.arange(len(x))[:, None] < np.arange(len(y))
            i, j = np.nonzero(keep)
            n = m[i, j].astype(np.int64)
            for k in range(STEP, CHECKS, STEP):
                if not len(i):
                    break
                n += (x[i, k : k + STEP] == y[j, k : k + STEP]).sum(axis=1)
                ok = n >= limits[k + STEP]
                i, j, n = i[ok], j[ok], n[ok]
            if len(i):
                yield i + a, j + b


def _verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of sorted shingle sets reaches the threshold, exactly."""
    size = np.array([len(s) for s in sets])
    if len(i) <= 2 * len(np.unique(np.concatenate([i, j]))):
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        rows, cols = np.unique(i), np.unique(j)
        used = np.unique(np.concatenate([rows, cols]))
        _, ids, df = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        owner = np.repeat(used, size[used])
        shared = df[ids] > 1
        new = np.cumsum(df > 1) - 1
        ids, owner = new[ids[shared]], owner[shared]
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        at_row, at_col = np.full(len(sets), -1), np.full(len(sets), -1)
        at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
        total = np.zeros((len(rows), len(cols)), np.float32)
        for v in range(0, int(ids[-1]) + 1 if len(ids) else 0, 2048):
            s, e = np.searchsorted(ids, [v, v + 2048])
            m = np.zeros((len(used), 2048), np.float32)
            m[np.searchsorted(used, owner[s:e]), ids[s:e] - v] = 1
            total += m[np.searchsorted(used, rows)] @ m[np.searchsorted(used, cols)].T
        inter = total[at_row[i], at_col[j]].astype(np.int64)
    return inter >= threshold * (size[i] + size[j] - inter) - 1e-9


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component, edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


EDGES = "a long, b long"


def _forest(batches, threshold: float):
    """Of rows (key, x, y, side, node, checks) in order of the first three: edges that connect what surviving pairs of each group connect."""
    limits = {k: least_matches(k, threshold) for k in range(STEP, CHECKS + 1, STEP)}

    def group(sides, nodes, checks):
        sig, side, nodes = np.frombuffer(b"".join(checks), np.uint32).reshape(-1, CHECKS), np.array(sides), np.array(nodes, np.int64)
        # copies of one text mostly survive with the first of them, and are connected then
        hub = (sig == sig[0]).sum(axis=1) >= limits[CHECKS]
        ei, ej = [np.flatnonzero(hub)], [np.zeros(int(hub.sum()), np.int64)]
        if not hub.all():
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i, j in _pairs(sig[a], sig[b] if len(b) else sig[a], not len(b), limits):
                i, j = a[i], (b if len(b) else a)[j]
                root = _roots(len(nodes), i, j)
                k = np.flatnonzero(root != np.arange(len(nodes)))
                ei.append(k)
                ej.append(root[k])
        root = _roots(len(nodes), np.concatenate(ei), np.concatenate(ej))
        k = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[root[k]])], ["a", "b"])

    key, held = None, []
    for batch in small_batches(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if held:
                    yield group(*zip(*held, strict=True))
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield group(*zip(*held, strict=True))


LINKED = "node long, links long, root long"


def _link(batches, threshold: float):
    """Of rows (cluster, i, j, side, node, copies, checks, text) in order of the first three: the links of each group."""
    limits = {k: least_matches(k, threshold) for k in range(STEP, CHECKS + 1, STEP)}

    def group(nodes, sides, copies, checks, texts):
        sig = np.frombuffer(b"".join(checks), np.uint32).reshape(-1, CHECKS)
        sets: list[np.ndarray] = []
        for a, z in chunks(texts):
            runs, off = shingles(*word_hashes(texts[a:z]), NGRAM)
            sets += [np.unique(runs[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)]
        side, copies, nodes = np.array(sides), np.array(copies, np.int64), np.array(nodes, np.int64)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, ei, ej = np.zeros(len(nodes), np.int64), [], []
        for i, j in _pairs(sig[a], sig[b] if len(b) else sig[a], not len(b), limits):
            i, j = a[i], (b if len(b) else a)[j]
            ok = _verify(sets, i, j, threshold)
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # a forest of the tile is enough for the classes
            root = _roots(len(nodes), i, j)
            k = np.flatnonzero(root != np.arange(len(nodes)))
            ei.append(k)
            ej.append(root[k])
        if not ei:
            return None
        root = _roots(len(nodes), np.concatenate(ei), np.concatenate(ej))
        k = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(links[k]), pa.array(nodes[root[k]])], ["node", "links", "root"])

    key, held = None, []
    for batch in small_batches(batches):
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:3] != key:
                if held and (out := group(*zip(*held, strict=True))):
                    yield out
                key, held = row[:3], []
            held.append((row[4], row[3], *row[5:]))
    if held and (out := group(*zip(*held, strict=True))):
        yield out


def _in_blocks(rows: DataFrame, by: str, size: str, columns: list[str]) -> DataFrame:
    """Rows of a group `by` of `size` rows dealt to a task for each two blocks of it: (by, x, y, side, *columns), in their order."""
    m = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("m", m).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select(by, F.least("i", "o").alias("x"), F.greatest("i", "o").alias("y"), F.when(F.col("i") > F.col("o"), 1).otherwise(0).alias("side"), *columns)
    return rows.repartition(by, "x", "y").sortWithinPartitions(by, "x", "y")


def _sized(clusters: DataFrame) -> DataFrame:
    return clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")


def _cut_chains(clusters: DataFrame, shared: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Clusters (node, component), those of more than BLOCK documents cut into what surviving pairs of one band key connect."""
    sized = written(_sized(clusters), "sized")
    large = sized.where(F.col("size") > BLOCK).select("node")
    if large.isEmpty():
        return sized
    members = shared.join(large, "node").join(reps.select("node", "checks"), "node")
    tasks = _in_blocks(members, "key", "n", ["node", "checks"])
    edges = written(tasks.mapInArrow(lambda b: _forest(b, threshold), EDGES), "surviving")
    again = connected_components(edges, "chains")
    return written(_sized(sized.where(F.col("size") <= BLOCK).select("node", "component").union(again)), "cut")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for every document.

    Two documents are linked if the Jaccard similarity of their sets of five-word runs is at least
    `threshold` (a text of one to four words is one run). n_links counts the other documents a
    document is linked to, copies included; class_id is the smallest id reachable over links.
    A document without words (null, empty, signs only) is linked to none. Rows of equal doc_id are
    one document, of which the greatest text counts; a null doc_id gives one row (null, null, 0)
    for each such row. An empty table gives none. Ids are whole numbers.
    Only the two columns named are read.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    known = rows.where("doc_id is not null")
    signed = written(known.mapInArrow(_sign, SIGNED), "signed")
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        discard(signed)
        known = written(known.groupBy("doc_id").agg(F.max("text").alias("text")), "one-row-each")
        signed = written(known.mapInArrow(_sign, SIGNED), "signed")
    copies = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = written(copies, "copies")
    reps = signed.join(copies.select(F.col("rep").alias("doc_id"), "copies"), "doc_id")
    reps = written(reps.select(F.col("doc_id").alias("node"), "copies", "bands", "checks"), "representatives")
    keys = reps.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(heads, "key"), "shared-keys")
    stars = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = _cut_chains(connected_components(stars, "candidates"), shared.select("node", "key", "n"), reps, threshold)
    member = clusters.join(reps.select("node", "copies", "checks"), "node")
    member = member.join(known.select(F.col("doc_id").alias("node"), "text"), "node")
    # a cluster of m blocks is a task for each two blocks, and each member goes to m of them
    tasks = _in_blocks(member, "component", "size", ["node", "copies", "checks", "text"])
    found = written(tasks.mapInArrow(lambda b: _link(b, threshold), LINKED), "links")
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rep = copies.join(links, copies.rep == links.node, "left").drop("node").join(classes, F.col("rep") == classes.node, "left")
    rep = rep.select("digest", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "digest").join(rep, "digest", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    nameless = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(nameless)


def keep_first_of_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each class of near copies, that of the smallest id; documents without an id stay.

    Of rows of equal id, one stays: the first by text, greatest first, then by the other columns.
    """
    rows, names = renamed(docs)
    text, doc_id = (f"c{place(names, c)}" for c in (text, doc_id))
    marks = near_duplicates(rows, text, doc_id, threshold).where("doc_id = class_id").select(F.col("doc_id").alias("keep"))
    out = rows.join(marks, F.col(doc_id).cast("long") == F.col("keep"), "left_semi")
    if not out.groupBy(doc_id).count().where("count > 1").isEmpty():
        order = [F.col(text).desc(), *(F.col(c).asc() for c in rows.columns if c != text)]
        out = out.withColumn("n", F.row_number().over(Window.partitionBy(doc_id).orderBy(*order))).where("n = 1").drop("n")
    return out.union(rows.where(F.col(doc_id).isNull())).toDF(*names)
