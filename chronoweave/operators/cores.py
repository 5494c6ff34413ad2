"""Coreness and connected cores of many graphs at once.

A graph of up to KERNEL_EDGES edges is peeled in one task (a group each); larger ones, told by a
count beforehand, go through joins: coreness as the fixed point of h-indexes, components by
contracting edges to their least ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import use_checkpoints

KERNEL_EDGES = 5_000_000


def peel(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, coreness) of a simple graph: rounds take all nodes of the least degree left. A node is looked at when
    its degree changes, so the work follows the edges, however many rounds there are."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, m = len(nodes), len(u)
    a, b = flat[:m], flat[m:]
    ends = np.concatenate([a, b])
    near = np.concatenate([b, a])[np.argsort(ends, kind="stable")]
    degree = np.bincount(ends, minlength=n)
    start = np.concatenate([[0], np.cumsum(degree)])
    left, core, gone = degree.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    # nodes wait under their degree, once more each time it falls
    order = np.argsort(degree, kind="stable")
    cut = np.searchsorted(degree[order], np.arange(int(degree.max()) + 2 if n else 1))
    waiting = [[order[s:e]] for s, e in zip(cut[:-1], cut[1:], strict=True)]
    for k in range(len(waiting)):
        while waiting[k]:
            now = np.unique(np.concatenate(waiting[k]))
            waiting[k] = []
            now = now[~gone[now]]  # one that waits higher up too has gone when its turn comes there
            if not len(now):
                continue
            core[now], gone[now] = k, True
            size = start[now + 1] - start[now]
            reach = near[np.repeat(start[now] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            reach, less = np.unique(reach[~gone[reach]], return_counts=True)
            left[reach] -= less
            level = np.maximum(left[reach], k)
            for d in np.unique(level):
                waiting[d].append(reach[level == d])
    return nodes, core


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, component): the least node of each connected component."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def coreness(edges: DataFrame, by: list[str] | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(*by, node, core) of simple graphs (*by, u, v); nodes without edges have no row."""
    by = by or ["t"]
    large = edges.groupBy(*by).count().where(F.col("count") > kernel_edges).select(*by)
    if not large.isEmpty():
        rest = edges.join(large, by, "left_anti")
        return coreness_by_joins(edges.join(large, by), by).unionByName(_coreness_kernel(rest, by))
    return _coreness_kernel(edges, by)


def _coreness_kernel(edges: DataFrame, by: list[str]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, core = peel(pdf.u.to_numpy(), pdf.v.to_numpy())
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "node": nodes, "core": core.astype(np.int32)})

    kinds = dict(edges.dtypes)
    return edges.select(*by, "u", "v").groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", node long, core int")


def h_indexes(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(*by, name): of each group the greatest h so that h of its values are at least h.

    Values are counted first, so a hub's neighbours never stand in one row: a group has as many rows as different values.
    """
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("of_value"))
    over = F.sum("of_value").over(Window.partitionBy(*by).orderBy(F.col(value).desc()))
    return n.withColumn("of_value", F.least(over, F.col(value))).groupBy(*by).agg(F.max("of_value").cast("int").alias(name))


def coreness_by_joins(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same by joins: h-indexes of the neighbours' values from the degrees on, until none changes. Lineage is cut each round by checkpoint()."""
    by = by or ["t"]
    use_checkpoints(edges.sparkSession)
    sides = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("u", "v"), ("v", "u"))]
    adj = edges.select(*by, F.explode(F.array(*sides)).alias("x")).select(*by, "x.a", "x.b").checkpoint()
    core = adj.groupBy(*by, "a").agg(F.count(F.lit(1)).cast("int").alias("core")).checkpoint()
    while True:
        near = core.select(*by, F.col("a").alias("b"), F.col("core").alias("c"))
        new = h_indexes(adj.join(near, [*by, "b"]), [*by, "a"], "c", "new")
        both = core.join(new, [*by, "a"]).checkpoint()
        core = both.select(*by, "a", F.col("new").cast("int").alias("core"))
        if both.where("core <> new").isEmpty():
            return core.select(*by, F.col("a").alias("node"), "core")


def connected(edges: DataFrame, by: list[str], kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(*by, node, component_id) of graphs (*by, u, v); component_id is the least node."""
    large = edges.groupBy(*by).count().where(F.col("count") > kernel_edges).select(*by)
    if not large.isEmpty():
        rest = edges.join(large, by, "left_anti")
        return connected_by_joins(edges.join(large, by), by).unionByName(_connected_kernel(rest, by))
    return _connected_kernel(edges, by)


def _connected_kernel(edges: DataFrame, by: list[str]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, root = components(pdf.u.to_numpy(), pdf.v.to_numpy())
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "node": nodes, "component_id": root})

    kinds = dict(edges.dtypes)
    return edges.select(*by, "u", "v").groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", node long, component_id long")


def connected_by_joins(edges: DataFrame, by: list[str]) -> DataFrame:
    """The same by joins: labels spread to neighbours and along themselves until none changes."""
    use_checkpoints(edges.sparkSession)
    sides = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("u", "v"), ("v", "u"), ("u", "u"), ("v", "v"))]
    adj = edges.select(*by, F.explode(F.array(*sides)).alias("x")).select(*by, "x.a", "x.b").distinct().checkpoint()
    label = adj.groupBy(*by, "a").agg(F.min("b").alias("l")).checkpoint()
    while True:
        near = adj.join(label.select(*by, F.col("a").alias("b"), "l"), [*by, "b"]).groupBy(*by, "a").agg(F.min("l").alias("m"))
        hop = near.join(label.select(*by, F.col("a").alias("m"), F.col("l").alias("ml")), [*by, "m"])
        both = hop.select(*by, "a", F.least("m", "ml").alias("new")).join(label, [*by, "a"]).checkpoint()
        label = both.select(*by, "a", F.col("new").alias("l"))
        if both.where("new <> l").isEmpty():
            return label.select(*by, F.col("a").alias("node"), F.col("l").alias("component_id"))


def with_core(nodes: DataFrame, core: DataFrame) -> DataFrame:
    """(t, node, core): nodes of loops only have coreness 0."""
    return nodes.join(core, ["t", "node"], "left").select("t", "node", F.coalesce("core", F.lit(0)).alias("core"))


def edge_cores(edges: DataFrame, core: DataFrame) -> DataFrame:
    """(t, u, v, min_core)."""
    a, b = (core.select("t", F.col("node").alias(x), F.col("core").alias(f"c{x}")) for x in ("u", "v"))
    return edges.join(a, ["t", "u"]).join(b, ["t", "v"]).select("t", "u", "v", F.least("cu", "cv").alias("min_core"))


def kcore_components(min_core_edges: DataFrame, ks: tuple[int, ...] = (3, 4, 5, 6, 7)) -> DataFrame:
    """(t, k, component_id, node): the connected parts of each k-core; every node of a k-core has an edge in it."""
    rows = min_core_edges.where(F.col("min_core") >= min(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("min_core >= k")
    return connected(rows.select("t", "k", "u", "v"), ["t", "k"]).select("t", "k", "component_id", "node")


def peel_component(u, v, q: int, k: int) -> np.ndarray:
    """The sorted component of q in the k-core of a graph; empty if q isn't in it."""
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    if not len(u):
        return np.zeros(0, np.int64)
    nodes, core = peel(u, v)
    inside = nodes[core >= k]
    keep = np.isin(u, inside) & np.isin(v, inside)
    if not keep.any():
        return np.zeros(0, np.int64)
    nodes, root = components(u[keep], v[keep])
    own = root[nodes == q]
    return nodes[root == own[0]] if len(own) else np.zeros(0, np.int64)

