"""Communities of queries (query, k, t): candidates from history, scored edges, peeling and breadth-first search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import drop, kept
from .cores import components, connected, peel, peel_component
from .snapshots import adjacency, edge_history

FEW = 200_000  # short rows that every task may hold
BITS = 62  # of a mask
PART_EDGES = 8_000_000  # of a part of a history that one task labels


def candidates(queries: DataFrame, kcore: DataFrame) -> DataFrame:
    """(query, k, t, node): members of every component of a k-core of snapshots up to t that holds the query."""
    own = kcore.select("k", F.col("node").alias("query"), F.col("t").alias("at"), "component_id")
    hit = queries.select("query", "k", "t").join(own, ["query", "k"]).where("at <= t")
    members = kcore.select("k", F.col("t").alias("at"), "component_id", "node")
    return hit.join(members, ["k", "at", "component_id"]).select("query", "k", "t", "node").distinct()


def candidate_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(query, k, t, u, v, first_t): edges met up to t between candidates."""
    hist = edge_history(edges)
    key = ["query", "k", "t"]
    # sets that overlap compress well on disk: their files' size says nothing about their rows, so nothing here is broadcast by it
    found = found.hint("merge")
    one = found.select(*key, F.col("node").alias("u")).join(hist, "u").where("first_t <= t")
    return one.join(found.select(*key, F.col("node").alias("v")), [*key, "v"]).select(*key, "u", "v", "first_t")


def recency_score(pairs: DataFrame, edges: DataFrame, decay: float = 0.5) -> DataFrame:
    """`pairs` with `score`: 1 - decay^x, x the sum of decay^(t - s) over snapshots s <= t with the edge. The built-in scorer; any other takes its place."""
    at = pairs.select("t", "u", "v").distinct()  # a pair's score is the same for every query of a time
    met = edges.select("u", "v", F.col("t").alias("at"))
    w = at.join(met, ["u", "v"]).where("at <= t").groupBy("t", "u", "v").agg(F.sum(F.pow(F.lit(decay), F.col("t") - F.col("at"))).alias("x"))
    return pairs.hint("merge").join(w, ["t", "u", "v"]).withColumn("score", 1 - F.pow(F.lit(decay), F.col("x"))).select(*pairs.columns, "score")


def over(score: Column, threshold: float, strict: bool) -> Column:
    """Scorers differ in whether a score at the threshold counts."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is 0 to 1")
    return score > threshold if strict else score >= threshold


def peel_queries(queries: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """(query, k, t, node): the query's component in the k-core of its own edges (query, k, t, u, v). A query's edges are one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, k, t = int(pdf["query"].iloc[0]), int(pdf["k"].iloc[0]), int(pdf["t"].iloc[0])
        nodes = peel_component(pdf.u.to_numpy(), pdf.v.to_numpy(), q, k)
        return pd.DataFrame({"query": q, "k": k, "t": t, "node": nodes})

    rows = kept_edges.join(queries.select("query", "k", "t").distinct(), ["query", "k", "t"], "left_semi")
    return rows.groupBy("query", "k", "t").applyInPandas(run, "query long, k int, t int, node long")


def candidate_sets(queries: DataFrame, kcore: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, k, t, set_id) and (query, k, t, node) of the distinct sets, `query` being the set's id there.

    Queries of one k and t mostly meet the same past components; what follows is done once for each such set.
    """
    own = kcore.select("k", F.col("node").alias("query"), F.col("t").alias("at"), "component_id")
    hit = queries.select("query", "k", "t").join(own, ["query", "k"]).where("at <= t")
    parts = hit.groupBy("query", "k", "t").agg(F.array_sort(F.collect_set(F.struct("at", "component_id"))).alias("parts"))
    of = parts.select("query", "k", "t", F.xxhash64("parts").alias("set_id"), "parts")
    sets = of.groupBy("k", "t", "set_id").agg(F.first("parts").alias("parts")).withColumn("p", F.explode("parts"))
    sets = sets.select(F.col("set_id").alias("query"), "k", "t", "p.at", "p.component_id")
    members = kcore.select("k", F.col("t").alias("at"), "component_id", "node")
    return of.drop("parts"), sets.join(members, ["k", "at", "component_id"]).select("query", "k", "t", "node").distinct()


def scored_pairs(queries: DataFrame, kcore: DataFrame, edges: DataFrame, decay: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(place, k, t, at, queries) and (u, v, first_t, met, scores, masks): every past edge between candidates once, however many
    queries have it, scored as by recency_score at each query time.

    Queries of one k and t are bits of one mask, or several; `place` is a mask's place in `masks`, `at` that of its time in `scores`
    and queries are (bit, query). met are the edge's snapshots. `dealt` makes a row for each query of it, where one is needed.
    """
    times = sorted(r.t for r in queries.select("t").distinct().collect())  # query times
    number = F.row_number().over(Window.partitionBy("t", "k").orderBy("query")) - 1
    bits = queries.select("query", "k", "t").distinct().withColumn("i", number)
    place = F.dense_rank().over(Window.orderBy("t", "k", F.floor(F.col("i") / BITS))) - 1  # one row for each query
    bits = kept(bits.select("query", "k", "t", place.alias("place"), (F.col("i") % BITS).alias("bit")))
    of = bits.groupBy("place", "k", "t").agg(F.collect_list(F.struct("bit", "query")).alias("queries"))
    of = kept(of.withColumn("at", F.array_position(F.array(*map(F.lit, times)).cast("array<int>"), F.col("t"))))
    places = of.count()
    # the queries that meet each past component, then of each node those whose components it was in
    own = kcore.select("k", F.col("node").alias("query"), F.col("t").alias("seen"), "component_id")
    hit = bits.join(own, ["query", "k"]).where("seen <= t").withColumn("mask", F.expr("shiftleft(1L, bit)"))
    parts = hit.groupBy("k", "seen", "component_id", "place").agg(F.bit_or("mask").alias("mask")).groupBy("k", "seen", "component_id").agg(F.collect_list(F.struct("place", "mask")).alias("x"))
    parts = kept(parts)
    nodes = kcore.select("node", "k", F.col("t").alias("seen"), "component_id").repartition("node").join(_few(parts), ["k", "seen", "component_id"])
    nodes = nodes.select("node", F.explode("x").alias("x")).groupBy("node", "x.place").agg(F.bit_or("x.mask").alias("mask"))
    nodes = nodes.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", "mask"))).alias("m"))
    each = F.sequence(F.lit(0), F.lit(max(places, 1) - 1))
    nodes = kept(nodes.select("node", F.transform(each, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("masks")))
    met = edges.groupBy("u", "v").agg(F.sort_array(F.collect_list("t")).alias("met"))
    for side, name in (("u", "a"), ("v", "b")):
        met = met.join(nodes.select(F.col("node").alias(side), F.col("masks").alias(name)).hint("merge"), side)
    rows = met.select("u", "v", F.col("met")[0].alias("first_t"), "met", F.zip_with("a", "b", lambda x, y: x.bitwiseAND(y)).alias("masks"))
    rows = rows.where(F.exists("masks", lambda x: x != 0))

    def score(t: int) -> Column:
        x = F.aggregate(F.filter("met", lambda s: s <= t), F.lit(0.0), lambda x, s: x + F.pow(F.lit(decay), F.lit(t) - s))
        return F.when(F.col("first_t") <= t, 1 - F.pow(F.lit(decay), x))

    scores = F.array(*map(score, times)).cast("array<double>")
    return of, kept(rows.select("u", "v", "first_t", "met", scores.alias("scores"), "masks"))


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast if a count says that they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def by_mask(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, t, u, v, first_t, met, score, mask, queries): edges of `scored_pairs`, a row for each k and t; some of `queries` are in the mask."""
    rows = pairs.select("u", "v", "first_t", "met", "scores", F.posexplode("masks").alias("place", "mask")).where("mask <> 0")
    rows = rows.join(_few(of), "place").where("first_t <= t")
    return rows.select("k", "t", "u", "v", "first_t", "met", F.element_at("scores", F.col("at").cast("int")).alias("score"), "mask", "queries")


def dealt(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each query of `scored_pairs`: (query, k, t, u, v, first_t, score). No row of it is shuffled."""
    rows = by_mask(of, pairs).withColumn("x", F.explode("queries")).where(F.expr("(shiftright(mask, x.bit) & 1) = 1"))
    return rows.select("x.query", "k", "t", "u", "v", "first_t", "score")


def peeled_parts(kept_edges: DataFrame) -> DataFrame:
    """(query, k, t, node, component_id): all connected parts of the k-core of each query's edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, k, t = int(pdf["query"].iloc[0]), int(pdf["k"].iloc[0]), int(pdf["t"].iloc[0])
        u, v = pdf.u.to_numpy(), pdf.v.to_numpy()
        nodes, core = peel(u, v)
        inside = nodes[core >= k]
        keep = np.isin(u, inside) & np.isin(v, inside)
        nodes, root = components(u[keep], v[keep]) if keep.any() else (inside[:0], inside[:0])
        return pd.DataFrame({"query": q, "k": k, "t": t, "node": nodes, "component_id": root})

    return kept_edges.select("query", "k", "t", "u", "v").groupBy("query", "k", "t").applyInPandas(run, "query long, k int, t int, node long, component_id long")


def link_communities(queries: DataFrame, kcore: DataFrame, edges: DataFrame, threshold: float = 0.5, strict: bool = False, scorer: Callable[[DataFrame, DataFrame], DataFrame] = recency_score) -> DataFrame:
    """(query, k, t, node): candidates, their past edges, scores, threshold, peel; once for each distinct candidate set.

    Edges are scored once for each time, not for each set, and only those that reach the threshold are dealt to the sets.
    """
    of, sets = candidate_sets(queries, kcore)
    times = sorted(r.t for r in queries.select("t").distinct().collect())  # query times
    met = edge_history(edges).withColumn("t", F.explode(F.array(*map(F.lit, times)).cast("array<int>"))).where("first_t <= t")
    pairs = met.select(F.lit(0).cast("long").alias("query"), F.lit(0).alias("k"), "t", "u", "v", "first_t")
    linked = kept(scorer(pairs, edges).where(over(F.col("score"), threshold, strict)).select("t", "u", "v"))
    sets = kept(sets)
    inside = linked.join(sets.withColumnRenamed("node", "u").hint("merge"), ["t", "u"]).join(sets.withColumnRenamed("node", "v").hint("merge"), ["query", "k", "t", "v"])
    parts = peeled_parts(inside).withColumnRenamed("query", "set_id")
    key = ["set_id", "k", "t"]
    own = of.join(parts.withColumnRenamed("node", "query"), [*key, "query"])
    return own.join(parts, [*key, "component_id"]).select("query", "k", "t", "node")


def threshold_bfs(queries: DataFrame, edges: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers from each query over all edges met up to t, while the predicted coreness (t, node, pred) is at least k.

    Gives (query, k, t, node, pred, layer, inside) of every node looked at - those under k are counted
    but not passed - and (query, k, t, layers).
    """
    key = ["query", "k", "t"]
    hist = edge_history(edges)
    adj = kept(hist.select("u", "v", "first_t").union(hist.select("v", "u", "first_t")).toDF("a", "b", "first_t"))
    pred = predicted.select("t", "node", "pred")

    def look(rows: DataFrame, layer: int) -> DataFrame:
        out = rows.join(pred, ["t", "node"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
        return out.select(*key, "node", "pred", F.lit(layer).alias("layer"), (F.col("pred") >= F.col("k")).alias("inside"))

    layer = 1
    front = kept(look(queries.select(*key, F.col("query").alias("node")).distinct(), layer))
    seen = front
    while True:
        # layers are only added to each other: none is written twice
        near = front.where("inside").join(adj, F.col("node") == F.col("a")).where("first_t <= t").select(*key, F.col("b").alias("node")).distinct()
        near = near.join(seen.select(*key, "node"), [*key, "node"], "left_anti")
        layer += 1
        front = kept(look(near, layer))
        if front.isEmpty():
            drop(front)
            break
        seen = seen.union(front)
    return seen, seen.groupBy(*key).agg(F.max("layer").alias("layers"))


def searched_parts(queries: DataFrame, edges: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What threshold_bfs looks at, once for all queries of one k and t that reach each other.

    Gives (query, k, t, part) and (k, t, part, node, pred, inside): of each connected part of the nodes predicted at k or more that
    holds a query, those nodes and the ones under k beside them. A query that is under k itself is a part of its own, named -1 - query.
    """
    wanted = queries.select("k", "t").distinct()
    times, ks = (sorted({r[i] for r in wanted.collect()}) for i in (1, 0))  # query times and thresholds
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    pred = kept(predicted.where(F.col("t").isin(times)).select("t", "node", F.coalesce("pred", F.lit(0)).alias("pred")))
    met = edge_history(edges).withColumn("t", F.explode(array(times))).where("first_t <= t")
    for side in "uv":
        met = met.join(pred.select("t", F.col("node").alias(side), F.col("pred").alias(f"p{side}")).hint("merge"), ["t", side], "left")
    met = kept(met.select("t", "u", "v", F.coalesce("pu", F.lit(0)).alias("pu"), F.coalesce("pv", F.lit(0)).alias("pv")))
    each = met.withColumn("k", F.explode(array(ks)))
    label = kept(connected(each.where("least(pu, pv) >= k").select("t", "k", "u", "v"), ["t", "k"], PART_EDGES))
    first = queries.select("query", "k", "t").distinct().join(pred.withColumnRenamed("node", "query"), ["t", "query"], "left")
    first = first.join(label.withColumnRenamed("node", "query"), ["t", "k", "query"], "left")
    under = F.coalesce("pred", F.lit(0)) < F.col("k")
    of = kept(first.select("query", "k", "t", F.when(under, -1 - F.col("query")).otherwise(F.coalesce("component_id", "query")).alias("part"), F.coalesce("pred", F.lit(0)).alias("pred"), under.alias("alone"), F.col("component_id").isNull().alias("single")))
    # a query without a neighbour at k or more has no label
    own = of.where("single").select("t", "k", F.col("query").alias("node"), "part", "pred", (~F.col("alone")).alias("inside"))
    used = of.where("not single").select("k", "t", F.col("part").alias("component_id")).distinct()
    inner = label.join(_few(used), ["k", "t", "component_id"], "left_semi").select("t", "k", "node", F.col("component_id").alias("part"))
    inner = inner.join(pred.hint("merge"), ["t", "node"]).select("t", "k", "node", "part", "pred", F.lit(True).alias("inside")).union(own)
    inner = kept(inner)
    sides = F.array(F.struct(F.col("u").alias("node"), F.col("pu").alias("a"), F.col("v").alias("b"), F.col("pv").alias("pred")), F.struct(F.col("v").alias("node"), F.col("pv").alias("a"), F.col("u").alias("b"), F.col("pu").alias("pred")))
    rim = each.where("least(pu, pv) < k and greatest(pu, pv) >= k").select("t", "k", F.explode(sides).alias("x")).where("x.a >= k").select("t", "k", "x.node", "x.b", "x.pred")
    rim = rim.join(inner.where("inside").select("t", "k", "node", "part").hint("merge"), ["t", "k", "node"]).select("k", "t", "part", F.col("b").alias("node"), "pred", F.lit(False).alias("inside")).distinct()
    return of.select("query", "k", "t", "part"), kept(inner.select("k", "t", "part", "node", "pred", "inside").union(rim))


def dealt_parts(of: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (k, t, part, ...) for each query of `searched_parts`: (query, k, t, ...)."""
    rest = [c for c in rows.columns if c not in ("k", "t", "part")]
    return rows.join(_few(of), ["k", "t", "part"]).select("query", "k", "t", *rest)


def cumulative_components(predicted: DataFrame, edges: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(t, k, node, component_id) of nodes predicted (t, node, pred) at k or more, over all edges met up to t; each such node has a row."""
    ok = predicted.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("pred >= k").select("t", "k", "node")
    u = edge_history(edges).join(ok.withColumnRenamed("node", "u"), "u").where("first_t <= t").select("t", "k", "u", "v")
    inner = u.join(ok.withColumnRenamed("node", "v"), ["t", "k", "v"], "left_semi")
    found = connected(inner.select("t", "k", "u", "v"), ["t", "k"])
    return ok.join(found, ["t", "k", "node"], "left").select("t", "k", "node", F.coalesce("component_id", "node").alias("component_id"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(t, a, neighbours): each node's neighbours in each snapshot, sorted."""
    return adjacency(edges).groupBy("t", "a").agg(F.sort_array(F.collect_list("b")).alias("neighbours"))


def recover_components(queries: DataFrame, candidates_: DataFrame, scored: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """(query, k, t, node): of each query its component in the k-core of the candidates' edges whose score (query, k, t, u, v, score)
    reaches the threshold; a query that isn't among its own candidates has none."""
    key = ["query", "k", "t"]
    own = queries.select(*key).join(candidates_.where("node = query").select(*key), key, "left_semi")
    inside = scored.where(over(F.col("score"), threshold, strict))
    for side in "uv":
        inside = inside.join(candidates_.select(*key, F.col("node").alias(side)), [*key, side], "left_semi")
    return peel_queries(own, inside.select(*key, "u", "v"))


def extend_index(index: DataFrame, queries: DataFrame, kcore: DataFrame, t: int) -> DataFrame:
    """The incremental candidate index (query, k, node) after snapshot t: of the queries (query, k) that are in a k-core at t,
    the members of their component join their candidates. Only what isn't there yet is added; candidates never leave."""
    now = kcore.where(F.col("t") == t).select("k", "component_id", "node")
    own = queries.select("query", "k").distinct().join(now.withColumnRenamed("node", "query"), ["query", "k"])
    more = own.join(now, ["k", "component_id"]).select("query", "k", "node")
    return index.unionByName(more.join(index, ["query", "k", "node"], "left_anti"))
