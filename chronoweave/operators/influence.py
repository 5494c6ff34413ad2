"""Temporal personalised PageRank over snapshots: streaming state, exact walks and what is read from them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept, use_checkpoints
from .snapshots import adjacency

ALPHA, BETA, TOP, LEAST = 0.3, 0.5, 20, 1e-8
WALK_EDGES = 20_000_000  # of all snapshots; a task holds eight bytes of each
SCALE = 2.0**600  # of walks' masses, which so are far from the least number: what is met is told from what isn't
STATE, NORMS = "src long, node long, time int, score double", "src long, norm double"


def _rank(*by: str):
    return Window.partitionBy(*by).orderBy(F.round("score", 14).desc(), F.col("time").desc(), F.col("node"))


def advance(state: DataFrame, norms: DataFrame, snapshot: DataFrame, t: int, alpha: float = ALPHA, beta: float = BETA, top: int | None = TOP, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """State (src, node, time, score) and norms (src, norm) after snapshot t of edges (t, u, v); all reads are of the state before.

    Nodes without an edge in the snapshot keep theirs. top = None keeps every entry.
    """
    adj = adjacency(snapshot).select("a", "b")
    degree = adj.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    new = degree.join(norms, degree.a == norms.src, "left").select("a", F.coalesce("norm", F.lit(0.0)).alias("old"), (F.lit(beta) * F.coalesce("norm", F.lit(0.0)) + F.col("d")).alias("norm"))
    own = state.join(new, state.src == new.a).where("old > 0").select("src", "node", "time", (F.col("score") * beta * F.col("old") / F.col("norm")).alias("score"))
    met = adj.join(new, "a").select(F.col("a").alias("src"), F.col("b").alias("node"), F.lit(t).cast("int").alias("time"), (F.lit(alpha * (1 - alpha)) / F.col("norm")).alias("score"))
    of = state.select(F.col("src").alias("b"), "node", "time", "score")
    told = adj.join(new.select("a", "norm"), "a").join(of, "b").select(F.col("a").alias("src"), "node", "time", (F.col("score") * (1 - alpha) / F.col("norm")).alias("score"))
    rows = own.union(met).union(told).groupBy("src", "node", "time").agg(F.sum("score").alias("score")).where(F.col("score") > least)
    if top is not None:
        rows = rows.withColumn("r", F.row_number().over(_rank("src"))).where(F.col("r") <= top).drop("r")
    kept = state.join(degree.select(F.col("a").alias("src")), "src", "left_anti")
    old_norms = norms.join(degree.select(F.col("a").alias("src")), "src", "left_anti")
    return rows.union(kept.select("src", "node", "time", "score")), new.select(F.col("a").alias("src"), "norm").union(old_norms)


def stream(edges: DataFrame, times: list[int], alpha: float = ALPHA, beta: float = BETA, top: int | None = TOP, least: float = LEAST):
    """Yields (t, state, norms) over all snapshots in order. State and norms of a snapshot are one written table, as the
    next one reads them several times; edges that are stored by t are read a snapshot at a time."""
    spark = edges.sparkSession
    state, norms = spark.createDataFrame([], STATE), spark.createDataFrame([], NORMS)
    before = -1
    for t in times:
        if t <= before:
            raise ValueError("snapshots only move forward")
        state, norms = advance(state, norms, edges.where(F.col("t") == t), t, alpha, beta, top, least)
        # a norm is a row without a node
        none = (F.lit(None).cast(k).alias(c) for c, k in (("node", "long"), ("time", "int")))
        both = kept(state.select("src", "node", "time", "score").union(norms.select("src", *none, F.col("norm").alias("score"))))
        state, norms, before = both.where("node is not null"), both.where("node is null").select("src", F.col("score").alias("norm")), t
        yield t, state, norms


ANSWERS = "t int, src long, node long, time int, score double, weight double"


def answers_in_one_pass(edges: DataFrame, times: list[int], alpha: float = ALPHA, beta: float = BETA, top: int = TOP, least: float = LEAST) -> DataFrame:
    """ANSWERS of every source after every snapshot, by one task that holds `top` entries of each node; a norm after the last
    snapshot is a row without a node. The same as `stream`, for logs that a count has shown to be of up to WALK_EDGES edges."""
    spark = edges.sparkSession
    ids = np.sort(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().toArrow().column(0).to_numpy())
    known = spark.sparkContext.broadcast(ids)

    def out(t, src, node, time, score, weight, none=None):
        cols = [pa.array(np.full(len(src), t, np.int32)), pa.array(src), pa.array(node, mask=none), pa.array(time.astype(np.int32), mask=none), pa.array(score), pa.array(weight, mask=none)]
        return pa.RecordBatch.from_arrays(cols, ["t", "src", "node", "time", "score", "weight"])

    def run(batches):
        ids = known.value
        n = len(ids)
        norm, size = np.zeros(n), np.zeros(n, np.int32)
        node, time, score = np.zeros((n, top), np.int32), np.zeros((n, top), np.int32), np.zeros((n, top))
        slot = np.arange(top)

        def advance(t: int, u: np.ndarray, v: np.ndarray):
            ends, near = np.concatenate([u, v]), np.concatenate([v, u])
            near = near[np.argsort(ends, kind="stable")]
            degree = np.bincount(ends, minlength=n)
            start = np.cumsum(degree) - degree
            act = np.flatnonzero(degree)
            old, new = norm[act].copy(), beta * norm[act] + degree[act]
            cut = np.flatnonzero(np.diff(np.cumsum(degree[act]) // 50_000)) + 1  # sources at once: their rows stay small
            made = []
            for own, o, z in zip(np.split(act, cut), np.split(old, cut), np.split(new, cut), strict=True):
                if not len(own):
                    continue
                first, d = start[own[0]], degree[own]
                at = np.repeat(np.arange(len(own)), d)  # own's edges stand together
                b = near[first : first + len(at)]
                row, i = np.nonzero(slot < size[b][:, None])
                hold, j = np.nonzero((slot < size[own][:, None]) & (o > 0)[:, None])
                src = np.concatenate([hold, at, at[row]])
                key = np.concatenate([node[own[hold], j], b, node[b[row], i]]).astype(np.int64)
                when = np.concatenate([time[own[hold], j], np.full(len(at), t), time[b[row], i]]).astype(np.int64)
                got = np.concatenate([score[own[hold], j] * beta * o[hold] / z[hold], alpha * (1 - alpha) / z[at], score[b[row], i] * (1 - alpha) / z[at[row]]])
                key = (src * n + key) * (t + 1) + when
                order = np.argsort(key, kind="stable")
                key = key[order]
                head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                got, key = np.add.reduceat(got[order], head), key[head]
                key, got = key[got > least], got[got > least]
                when, key = key % (t + 1), key // (t + 1)
                src, key = key // n, key % n
                order = np.lexsort((key, -when, -np.floor(got * 1e14 + 0.5), src))
                src = src[order]
                count = np.bincount(src, minlength=len(own))
                place = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
                ok = place < top
                order, src, place = order[ok], src[ok], place[ok]
                made.append((own, np.minimum(count, top), own[src], place, key[order], when[order], got[order]))
            for own, count, src, place, key, when, got in made:  # all reads were of the state before
                size[own] = count
                node[src, place], time[src, place], score[src, place] = key, when, got
            norm[act] = new

        def answers(t: int):
            for a in range(0, n, 20_000):
                src, j = np.nonzero(slot < size[a : a + 20_000, None])
                total = np.where(slot < size[a : a + 20_000, None], score[a : a + 20_000], 0.0).sum(axis=1)
                yield out(t, ids[a + src], ids[node[a + src, j]], time[a + src, j], score[a + src, j], score[a + src, j] / total[src])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        now = 0  # a place in `times`

        def settle():
            u, v = (np.concatenate([w[i] for w in waiting]) if waiting else np.zeros(0, np.int64) for i in (0, 1))
            waiting.clear()
            if len(u):
                advance(times[now], u, v)
            yield from answers(times[now])

        for batch in batches:
            t, u, v = (batch.column(c).to_numpy() for c in range(3))
            while len(t):
                while t[0] > times[now]:
                    yield from settle()
                    now += 1
                some = int(np.searchsorted(t, times[now], side="right"))
                waiting.append((np.searchsorted(ids, u[:some]), np.searchsorted(ids, v[:some])))
                t, u, v = t[some:], u[some:], v[some:]
        while now < len(times):
            yield from settle()
            now += 1
        src = np.flatnonzero(norm > 0)
        none = np.ones(len(src), bool)
        yield out(times[-1], ids[src], np.zeros(len(src), np.int64), np.zeros(len(src), np.int32), norm[src], np.zeros(len(src)), none)

    rows = edges.where(F.col("t").isin(times)).select("t", "u", "v")
    return rows.repartition(1).sortWithinPartitions("t").mapInArrow(run, ANSWERS)


def answers_at(edges: DataFrame, queries: DataFrame | None, times: list[int], first: int = 20, **how) -> DataFrame:
    """(t, src, node, time, score, weight): the answers of each query (src, t) as of just after snapshot t, from one pass over the
    snapshots up to the last of `times`; without queries, those of every source at those times. A source not seen yet has none."""
    wanted, out = set(times), None
    for t, state, _ in stream(edges, list(range(max(wanted) + 1)), **how):
        if t in wanted:
            if queries is not None:
                state = state.join(queries.where(F.col("t") == t).select("src").distinct(), "src", "left_semi")
            now = state.select(F.lit(t).alias("t"), "src", "node", "time", "score")
            out = now if out is None else out.union(now)
    return top_answers(out, first, ("t", "src"))


def log_ages(answers: DataFrame) -> DataFrame:
    """`answers` with `age`: log1p of the snapshots from an influence's own time to the query's."""
    return answers.withColumn("age", F.log1p((F.col("t") - F.col("time")).cast("double")))


def top_answers(state: DataFrame, first: int = 20, by: tuple[str, ...] = ("src",)) -> DataFrame:
    """(*by, node, time, score, weight): the first entries of each source; weights are their shares."""
    rows = state.withColumn("r", F.row_number().over(_rank(*by))).where(F.col("r") <= first)
    return rows.withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy(*by))).drop("r")


def merged_scores(answers: DataFrame) -> DataFrame:
    """(src, node, score): times summed."""
    return answers.groupBy("src", "node").agg(F.sum("score").alias("score"))


def transitions(edges: DataFrame, before: int, beta: float = BETA) -> DataFrame:
    """(a, b, time, p): the chance that a walk at `a`, bound to snapshots before `before`, takes each of its past edges."""
    past = adjacency(edges.where(F.col("t") < before))
    age = F.dense_rank().over(Window.partitionBy("a").orderBy(F.col("t").desc())) - 1
    rows = past.withColumn("w", F.pow(F.lit(beta), age))
    return rows.select("a", "b", F.col("t").alias("time"), (F.col("w") / F.sum("w").over(Window.partitionBy("a"))).alias("p"))


def exact(edges: DataFrame, sources: DataFrame, t: int, alpha: float = ALPHA, beta: float = BETA, top: int | None = None, digits: int | None = None, walk_edges: int = WALK_EDGES) -> DataFrame:
    """(src, node, time, score) of the exact walk from (src, after t): strictly back in time, ending with alpha at each node but the
    source. top: of each source the first so many; digits: scores are rounded.

    Sources don't touch one another, so up to `walk_edges` edges every task holds all snapshots and walks its sources back through
    them, and nothing but the result is written; more edges go through joins. With `top` a source's walk ends where a bound says that
    no earlier snapshot has more for it than the last of its full list: what it then has is exact, as a walk only goes back.
    """
    past = edges.where(F.col("t") <= t)
    counts = sorted((r.t, r["count"]) for r in past.groupBy("t").count().collect())  # one row for each snapshot
    if sum(n for _, n in counts) > walk_edges:
        rows = exact_by_joins(edges, sources, t, alpha, beta, top)
        return rows if digits is None else rows.withColumn("score", F.round("score", digits))
    return _exact_kernel(past, [s for s, _ in counts], sources, alpha, beta, top, digits)


class _Walk:
    """A snapshot of a walk: its nodes by falling degree, their neighbours among them, and what of the mass at a node leaves over each edge and what stays."""

    def __init__(self, time: int, u: np.ndarray, v: np.ndarray, norm: np.ndarray, alpha: float, beta: float):
        ends, near = np.concatenate([u, v]), np.concatenate([v, u])
        degree = np.bincount(ends, minlength=len(norm))
        self.time, self.nodes = time, np.argsort(-degree, kind="stable")[: np.count_nonzero(degree)].astype(np.int32)
        place = np.zeros(len(norm), np.int32)
        place[self.nodes] = np.arange(len(self.nodes), dtype=np.int32)
        self.near = place[near[np.argsort(place[ends], kind="stable")]]
        self.degree = degree[self.nodes].astype(np.int32)
        new = beta * norm[self.nodes] + self.degree
        self.leave, self.stay = (1 - alpha) / new, beta * norm[self.nodes] / new
        norm[self.nodes] = new

    def step(self, mass: np.ndarray) -> np.ndarray:
        """What arrives at the snapshot's nodes; `mass` (nodes x sources) goes on with it."""
        here = mass[self.nodes]
        came = self.around(here * self.leave[:, None])
        mass[self.nodes] = here * self.stay[:, None] + came
        return came

    def around(self, out: np.ndarray) -> np.ndarray:
        """Of each of the snapshot's nodes the sum of its neighbours' rows."""
        came = np.zeros_like(out)
        start = np.cumsum(self.degree, dtype=np.int64) - self.degree
        for j in range(min(64, int(self.degree[0]))):
            n = int(np.searchsorted(-self.degree, -j, side="left"))  # nodes with over j neighbours
            came[:n] += out[self.near[start[:n] + j]]
        for i in range(int(np.searchsorted(-self.degree, -64, side="left"))):
            came[i] += out[self.near[start[i] + 64 : start[i] + self.degree[i]]].sum(axis=0)
        return came

    def moves(self, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of entries (source * n + node): their node's place in the snapshot, -1 if it isn't there, and its degree."""
        if not hasattr(self, "place"):
            self.place = np.full(n, -1, np.int32)
            self.place[self.nodes] = np.arange(len(self.nodes), dtype=np.int32)
            self.start = np.cumsum(self.degree, dtype=np.int64) - self.degree
        at = self.place[key % n]
        return at, np.where(at >= 0, self.degree[at], 0)

    def sparse_step(self, n: int, key: np.ndarray, mass: np.ndarray, at: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, ...]:
        """`step` for few entries (source * n + node, mass) in order of their keys: entries that arrive, and those that go on."""
        of = np.repeat(np.arange(len(key)), degree)
        edge = np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree, degree) + self.start[at[of]]
        came = _summed((key - key % n)[of] + self.nodes[self.near[edge]], (mass * self.leave[at])[of])
        on = _summed(np.concatenate([key, came[0]]), np.concatenate([np.where(at >= 0, mass * self.stay[at], mass), came[1]]))
        more = on[1] > 0
        return *came, on[0][more], on[1][more]


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(value[order], first)


class _Ahead:
    """Bounds on what one entry of the snapshots so far can get.

    `each`: of unit mass at a node. An entry of the last snapshot gets what one edge takes; one of an earlier snapshot gets it from
    the neighbours the mass went to and from what stayed. `all`: of unit mass at every node, walked back LOOK snapshots; as no node
    has more than the greatest mass after those, what is before them is bounded by that much of their own bound.
    """

    LOOK = 8

    def __init__(self, n: int):
        self.n, self.each, self.all, self.walks = n, np.zeros(n), [0.0], []

    def add(self, w: _Walk) -> None:
        at = w.nodes
        earlier = w.leave * w.around(self.each[at][:, None])[:, 0] + w.stay * self.each[at]
        self.each[at] = np.maximum(w.leave, earlier)
        self.walks = [*self.walks[-self.LOOK + 1 :], w]
        mass, most = np.ones((self.n, 1)), 0.0
        for x in reversed(self.walks):
            most = max(most, float(x.step(mass).max()))
        self.all.append(max(most, float(mass.max()) * self.all[-len(self.walks)]))

    def bounds(self) -> tuple[np.ndarray, float]:
        """Rounded up by more than sums of floats can err."""
        return (self.each * (1 + 1e-6)).astype(np.float32), self.all[-1] * (1 + 1e-6)


def _best(found: np.ndarray, more: np.ndarray, top: int) -> np.ndarray:
    """The first `top` entries (source, rounded score, time, node, score) of each source."""
    rows = np.concatenate([found, more])
    rows = rows[np.lexsort((rows["node"], -rows["time"], -rows["r"], rows["src"]))]
    first = np.flatnonzero(np.r_[True, rows["src"][1:] != rows["src"][:-1]]) if len(rows) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(rows)])
    return rows[np.arange(len(rows)) - np.repeat(first, size) < top]


def _walk_top(walks: Iterable[_Walk], ids: np.ndarray, src: np.ndarray, alpha: float, top: int) -> np.ndarray:
    """The first `top` entries (source, rounded score, time, node, score) of each of the sorted sources; `walks` is read from the
    latest snapshot on, as far as it is needed. Masses are sparse entries until their moves are many, and then arrays; sources that are done leave them."""
    n = len(ids)
    found = np.zeros(0, [("src", "i8"), ("r", "f8"), ("time", "i8"), ("node", "i8"), ("score", "f8")])
    cols = np.arange(len(src))  # sources that still walk, as places in src
    key, value, mass = cols * n + np.searchsorted(ids, src), np.full(len(src), SCALE), None
    for w in walks:
        # ties go to the later snapshot, so only more than the last of a full list comes in
        least = np.full(len(src), -1.0)
        own, count = np.unique(found["src"], return_counts=True)
        full = own[count >= top]
        least[np.searchsorted(src, full)] = found["r"][np.searchsorted(found["src"], full, side="right") - 1]
        least = least[cols]
        if mass is None:
            at, degree = w.moves(n, key)
            if int(degree.sum()) > len(w.near) * len(cols) // 64:
                mass = np.zeros((n, len(cols)))
                mass[key % n, key // n] = value
        if mass is None:
            met, came, key, value = w.sparse_step(n, key, value, at, degree)
            i, j = met % n, met // n
        else:
            came = w.step(mass)
            hit = came * (alpha / SCALE) > np.maximum(least - 1e-13, 0.0)
            open_ = np.flatnonzero(least < 0)
            if len(open_) and len(came) > top:
                hit[:, open_] &= came[:, open_] >= np.partition(came[:, open_], len(came) - top, axis=0)[len(came) - top] * (1 - 1e-9) - SCALE * 1e-13
            i, j = np.nonzero(hit)
            came, i = came[i, j], w.nodes[i]
        score = came * (alpha / SCALE)
        r = np.floor(score * 1e14 + 0.5) / 1e14
        new = r > least[j]
        more = np.zeros(np.count_nonzero(new), found.dtype)
        more["src"], more["r"], more["time"], more["node"], more["score"] = src[cols[j[new]]], r[new], w.time, ids[i[new]], score[new]
        found = _best(found, more, top)
        # what an entry of an earlier snapshot can still get: from masses over `flat` each by itself, from the rest as if all nodes had as much
        own, count = np.unique(found["src"], return_counts=True)
        full = np.zeros(len(src), bool)
        full[np.searchsorted(src, own[count >= top])] = True
        least = np.zeros(len(src))
        least[np.searchsorted(src, own)] = found["r"][np.searchsorted(found["src"], own, side="right") - 1]
        full, need = full[cols], np.maximum(least[cols] - 1e-13, 0.0) * (SCALE / alpha)
        flat = need / max(2 * w.all, 1e-9)
        if mass is None:
            far = np.bincount(key // n, np.maximum(value - flat[key // n], 0.0) * w.each[key % n], len(cols))
        else:
            far = w.each @ np.maximum(mass - flat, 0.0)
        keep = np.flatnonzero(~(full & (far + flat * w.all < need)))
        if len(keep) == len(cols):
            continue
        if not len(keep):
            break
        if mass is None:
            inside = np.isin(key // n, keep)
            key, value = key[inside], value[inside]
            key = np.searchsorted(keep, key // n) * n + key % n
        else:
            mass = np.ascontiguousarray(mass[:, keep])
        cols = cols[keep]
    return found


def _exact_kernel(past: DataFrame, times: list[int], sources: DataFrame, alpha: float, beta: float, top: int | None, digits: int | None) -> DataFrame:
    spark = past.sparkSession
    if not times:
        return spark.createDataFrame([], STATE)
    ids = np.sort(past.select(F.explode(F.array("u", "v")).alias("node")).distinct().toArrow().column(0).to_numpy())
    n = len(ids)
    norm, walks, ahead = np.zeros(n), [], _Ahead(n)
    for s in times:
        rows = past.where(F.col("t") == s).select("u", "v").toArrow()
        walk = _Walk(s, *(np.searchsorted(ids, rows.column(c).to_numpy()) for c in "uv"), norm, alpha, beta)
        if top is not None:
            walk.each, walk.all = ahead.bounds()  # of the snapshots before this one
            ahead.add(walk)
        walks.append(spark.sparkContext.broadcast(walk))
    known = spark.sparkContext.broadcast(ids)
    width = max(1, min(64, (1 << 21) // n))  # sources at once: their masses and moves stay small

    def walked(src: np.ndarray):
        ids = known.value
        if top is not None:
            found = _walk_top((w.value for w in reversed(walks)), ids, src, alpha, top)
            yield found["src"], found["node"], found["time"].astype(np.int32), found["score"]
            return
        mass = np.zeros((n, len(src)))
        mass[np.searchsorted(ids, src), np.arange(len(src))] = SCALE
        for w in reversed(walks):
            came, nodes = w.value.step(mass), ids[w.value.nodes]
            i, j = np.nonzero(came)
            yield src[j], nodes[i], np.full(len(i), w.value.time, np.int32), came[i, j] * alpha / SCALE

    def run(batches):
        mine = [b.column(0).to_numpy() for b in batches if b.num_rows]
        mine = np.unique(np.concatenate(mine)) if mine else np.zeros(0, np.int64)
        mine = mine[np.isin(mine, known.value)]
        for at in range(0, len(mine), width):
            for src, node, time, score in walked(mine[at : at + width]):
                if digits is not None:
                    score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(node), pa.array(time), pa.array(score)], ["src", "node", "time", "score"])

    parts = max(1, -(-n // (4 * width)))
    return sources.select(F.col("node").alias("src")).repartition(parts).mapInArrow(run, STATE)


def exact_by_joins(edges: DataFrame, sources: DataFrame, t: int, alpha: float = ALPHA, beta: float = BETA, top: int | None = None) -> DataFrame:
    """(src, node, time, score) of the exact walk from (src, after t): strictly back in time, ending with alpha at each node but the source. top: of each source the first so many."""
    spark = edges.sparkSession
    use_checkpoints(spark)
    hist = adjacency(edges.where(F.col("t") <= t)).select("a", "b", F.col("t").alias("time")).checkpoint()
    # chances for every bound at once: an edge's age counts the node's later snapshots before the bound
    at = hist.select("a", "time").distinct()
    bounds = at.join(at.select("a", F.col("time").alias("bound")), "a").where("time < bound").union(at.select("a", "time", F.lit(t + 1).alias("bound")))
    age = bounds.withColumn("w", F.pow(F.lit(beta), F.dense_rank().over(Window.partitionBy("a", "bound").orderBy(F.col("time").desc())) - 1))
    step = hist.join(age, ["a", "time"])
    step = step.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("a", "bound"))).select("a", "bound", "b", "time", "p").checkpoint()
    walk = sources.select(F.col("node").alias("src"), F.col("node").alias("a"), F.lit(t + 1).alias("bound"), F.lit(1.0).alias("mass"))
    found = None
    for _ in range(t + 1):
        moved = walk.join(step, ["a", "bound"]).groupBy("src", "b", "time").agg(F.sum(F.col("mass") * F.col("p") * (1 - alpha)).alias("mass")).checkpoint()
        if moved.isEmpty():
            break
        part = moved.select("src", F.col("b").alias("node"), "time", (F.col("mass") * alpha).alias("score"))
        found = part if found is None else found.union(part)
        walk = moved.select("src", F.col("b").alias("a"), F.col("time").alias("bound"), "mass")
    if found is None:
        return spark.createDataFrame([], STATE)
    out = found.groupBy("src", "node", "time").agg(F.sum("score").alias("score"))
    return out if top is None else out.withColumn("r", F.row_number().over(_rank("src"))).where(F.col("r") <= top).drop("r")


def weighted_structure(answers: DataFrame, shares: DataFrame, t_of: str = "time", by: tuple[str, ...] = ("src",)) -> DataFrame:
    """(*by, block, bucket, value): structure of the influences at their own times, by weight; an absent node has all in bucket 0."""
    s = shares.select(F.col("t").alias(t_of), "node", "block", "bucket", "share")
    found = answers.join(s, [t_of, "node"], "left")
    blocks = F.explode(F.array(*(F.lit(b) for b in ("h1", "h2", "h3", "core"))))
    none = found.where("block is null").withColumn("block", blocks).withColumn("bucket", F.lit(0)).withColumn("share", F.lit(1.0))
    rows = found.where("block is not null").unionByName(none)
    return rows.groupBy(*by, "block", "bucket").agg(F.sum(F.col("weight") * F.col("share")).alias("value"))
