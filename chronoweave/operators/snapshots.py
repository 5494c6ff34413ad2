"""Windows over an edge log and the simple graphs they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.edge_log import dense_ids

STEP, WINDOW = 86_400, 172_800


def window_plan(edges: DataFrame, step: int = STEP, window: int = WINDOW) -> tuple[int, int, int, int]:
    """(start of the first window, number of windows, first and last time). Windows are half open and the last one ends right after the last edge."""
    if step <= 0 or window <= 0:
        raise ValueError("step and window must be positive")
    lo, hi = edges.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        raise ValueError("no edges")
    end = hi + 1
    if end - window < lo:
        raise ValueError("the log spans less than a window")
    back = (end - lo - 1) // step
    return end - window - back * step, back + 1, lo, hi


def assign_windows(edges: DataFrame, s0: int, n: int, step: int = STEP, window: int = WINDOW) -> DataFrame:
    """`edges` with `window_index`, a row for each window that holds the edge, by arithmetic and not a range join.

    With step < window an edge is in several windows, with step > window it may be in none.
    """
    last = F.least(F.lit(n - 1), F.floor((F.col("ts") - s0) / F.lit(step)))
    first = F.greatest(F.lit(0), F.floor((F.col("ts") - s0 - window) / F.lit(step)) + 1)
    rows = edges.withColumn("__a", first.cast("long")).withColumn("__z", last.cast("long")).where("__a <= __z")
    return rows.withColumn("window_index", F.explode(F.sequence("__a", "__z"))).drop("__a", "__z")


def windows(edges: DataFrame, step: int = STEP, window: int = WINDOW) -> DataFrame:
    """(t, window_index, start_ts, end_ts, edge_count) of windows that hold an edge; t is their position."""
    s0, n, _, _ = window_plan(edges, step, window)
    counts = assign_windows(edges.select("ts"), s0, n, step, window).groupBy("window_index").agg(F.count(F.lit(1)).alias("edge_count"))
    counts = dense_ids(counts, "window_index", "place")  # steps of a second make many windows
    start = F.lit(s0) + F.col("window_index") * step
    return counts.select(F.col("place").cast("int").alias("t"), "window_index", start.alias("start_ts"), (start + window).alias("end_ts"), "edge_count")


def window_hashes(edges: DataFrame, step: int = STEP, window: int = WINDOW) -> DataFrame:
    """(window_index, sha256) of the records `u,v,ts` and a newline of each window, in order. One hash needs its records one after another, so a window is one task's."""
    s0, n, _, _ = window_plan(edges, step, window)
    line = F.concat_ws(",", "u", "v", "ts")
    rows = assign_windows(edges, s0, n, step, window).groupBy("window_index").agg(F.array_sort(F.collect_list(F.struct("ts", "ord", line.alias("line")))).alias("x"))
    return rows.select("window_index", F.sha2(F.array_join(F.transform("x", lambda r: F.concat(r["line"], F.lit("\n"))), ""), 256).alias("sha256"))


def manifest(edges: DataFrame, dataset: str, step: int = STEP, window: int = WINDOW) -> dict:
    s0, n, lo, hi = window_plan(edges, step, window)
    slices = [r.asDict() for r in windows(edges, step, window).orderBy("t").collect()]
    return {
        "dataset": dataset, "step_seconds": step, "window_seconds": window, "first_timestamp": lo, "last_timestamp": hi, "observation_end": hi + 1,
        "window_alignment": "right", "planned_slice_count": n, "slice_count": len(slices), "written_edge_count": sum(s["edge_count"] for s in slices), "slices": slices,
    }


def members(edges: DataFrame, step: int = STEP, window: int = WINDOW) -> DataFrame:
    """(t, u, v): every edge of every window, loops and repeats included."""
    s0, n, _, _ = window_plan(edges, step, window)
    at = windows(edges, step, window).select("window_index", "t")
    return assign_windows(edges.select("u", "v", "ts"), s0, n, step, window).join(at, "window_index").select("t", "u", "v")


def snapshot_edges(member_edges: DataFrame) -> DataFrame:
    """(t, u, v), u < v: simple undirected graphs."""
    return member_edges.where("u <> v").select("t", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def snapshot_nodes(member_edges: DataFrame) -> DataFrame:
    """(t, node): all endpoints, those of loops too."""
    return member_edges.select("t", F.explode(F.array("u", "v")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(t, a, b): both directions of simple edges."""
    return edges.select("t", F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("x")).select("t", "x.a", "x.b")


def first_seen(nodes: DataFrame) -> DataFrame:
    """(node, first_t)."""
    return nodes.groupBy("node").agg(F.min("t").alias("first_t"))


def cumulative_adjacency(edges: DataFrame, nodes: DataFrame, last: int) -> DataFrame:
    """(t, node, neighbours) for t up to `last`: every node seen up to t and its neighbours so far, sorted; a node without edges has an empty list."""
    hist = edge_history(edges)
    met = hist.select(F.col("u").alias("node"), F.col("v").alias("b"), F.col("first_t").alias("met")).union(hist.select("v", "u", "first_t"))
    rows = first_seen(nodes).where(F.col("first_t") <= last).withColumn("t", F.explode(F.sequence("first_t", F.lit(last)))).join(met, "node", "left")
    return rows.groupBy("t", "node").agg(F.sort_array(F.collect_list(F.when(F.col("met") <= F.col("t"), F.col("b")))).alias("neighbours"))


def edge_history(edges: DataFrame) -> DataFrame:
    """(u, v, first_t): each undirected edge's first snapshot."""
    return edges.groupBy("u", "v").agg(F.min("t").alias("first_t"))
