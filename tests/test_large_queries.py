"""Work that queries share is done once for all of them."""

import time

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry_points
from chronoweave.functions import ranking
from chronoweave.operators import communities, edge_generation, features, influence
from chronoweave.plans.base import graph
from tests.test_whole_queries import by_sql

DIR = "/root/testdata/sf0.001"


def test_edges_are_scored_once_for_all_queries(spark):
    g = graph(spark, DIR)
    of, pairs = g.scored_pairs
    assert pairs.count() == pairs.select("u", "v").distinct().count() < g.scored.count()
    want = communities.recency_score(communities.candidate_edges(g.candidates, g.edges), g.edges)
    assert sorted(map(tuple, g.scored.collect())) == sorted(map(tuple, want.select(g.scored.columns).collect()))
    for name in ("link_auc", "link_average_precision"):
        got = entry_points.queries()[name](spark, DIR).first()[0]
        assert abs(got - by_sql(entry_points.oracle_sql()[name])[0][0]) <= 1e-6


def test_rows_that_stand_for_many(spark):
    rows = spark.createDataFrame([(0.1, True, 3), (0.1, False, 2), (0.4, False, 1), (0.7, True, 4), (0.9, False, 2)], "s double, y boolean, n long")
    each = rows.selectExpr("s", "y", "explode(sequence(1L, n)) AS i")
    for f in (ranking.auc, ranking.average_precision):
        assert f(rows, "s", "y", "n").first()[0] == f(each, "s", "y").first()[0] is not None


def test_exact_walks_in_one_pass_equal_joins(spark):
    g = graph(spark, DIR)
    nodes = g.nodes.select("node").distinct()
    of = lambda df: {(r.src, r.node, r.time): r.score for r in df.collect()}
    for top in (None, 20):
        got, want = (of(influence.exact(g.edges, nodes, 12, top=top, walk_edges=most)) for most in (10**9, 0))
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-14 for x in want)
    # a hub, and a source without edges
    star = spark.createDataFrame([(t, 0, v) for t in (0, 1) for v in range(1, 150 + t)], "t int, u long, v long")
    ends = spark.createDataFrame([(0,), (7,), (999,)], "node long")
    got, want = (of(influence.exact(star, ends, 1, walk_edges=most)) for most in (10**9, 0))
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-14 for x in want)
    plan = influence.exact(g.edges, nodes, 12)._jdf.queryExecution().toString()
    assert "Join" not in plan  # no table of walks is written or shuffled


def test_walks_for_the_first_entries_end_early():
    rng = np.random.default_rng(3)
    n, times = 2_000, 60
    norm, ahead, walks = np.zeros(n), influence._Ahead(n), []
    for t in range(times):
        ends = rng.integers(0, n if t < times - 1 else n // 2, (2, 4 * n))  # half of the nodes aren't in the last snapshot
        ends = np.unique(np.sort(ends[:, ends[0] != ends[1]], axis=0), axis=1)
        w = influence._Walk(t, *ends, norm, influence.ALPHA, influence.BETA)
        w.each, w.all = ahead.bounds()
        ahead.add(w)
        walks.append(w)
    src, read, ids = np.array([0, 5, 700, 1_500, 1_999]), [], np.arange(n)
    got = influence._walk_top((read.append(w.time) or w for w in reversed(walks)), ids, src, influence.ALPHA, 20)
    assert len(read) < 15  # all 60 before
    want, mass = np.zeros(0, got.dtype), np.zeros((n, len(src)))
    mass[src, np.arange(len(src))] = 1.0
    left = []  # masses after each snapshot
    for w in reversed(walks):
        came = w.step(mass) * influence.ALPHA
        i, j = np.nonzero(came)
        more = np.zeros(len(i), got.dtype)
        more["src"], more["time"], more["node"], more["score"] = src[j], w.time, w.nodes[i], came[i, j]
        more["r"] = np.floor(more["score"] * 1e14 + 0.5) / 1e14
        want = influence._best(want, more, 20)
        for each, all_, before in left:  # what the bounds said of what is before them
            for c in range(len(src)):
                assert came[:, c].max() <= influence.ALPHA * min(before[:, c] @ each, before[:, c].max() * all_)
        left.append((w.each, w.all, mass.copy()))
    assert all((got[c] == want[c]).all() for c in ("src", "time", "node")) and abs(got["score"] - want["score"]).max() < 1e-15


def test_queries_share_what_they_search(spark):
    g = graph(spark, DIR)
    pred = g.core.withColumnRenamed("core", "pred")
    lone = spark.createDataFrame([(10**9, 3, g.n - 2)], "query long, k int, t int")  # a query that was never met
    of, found = communities.searched_parts(g.cohort.select("query", "k", "t").union(lone), g.edges, pred)
    got = communities.dealt_parts(of, found)
    want = communities.threshold_bfs(g.cohort.select("query", "k", "t").union(lone), g.edges, pred)[0].select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert found.count() < got.count()
    each = edge_generation.generate_edges(g.searched.where("inside").select("query", "k", "t", "node", "pred"), g.merged)
    assert sorted(map(str, g.generated.select(each.columns).collect())) == sorted(map(str, each.collect()))


def test_answers_in_one_pass_equal_joins(spark):
    g = graph(spark, DIR)
    times = list(range(8))
    rows = influence.answers_in_one_pass(g.edges, times).persist()
    *_, (_, state, norms) = influence.stream(g.edges, times)
    of = lambda df: {tuple(r[:-1]): r[-1] for r in df.collect()}
    last = rows.where("t = 7 and node is not null")
    for got, want in ((last.select("src", "node", "time", "weight"), influence.top_answers(state).select("src", "node", "time", "weight")), (last.select("src", "node", "time", "score"), state), (rows.where("node is null").select("src", "score"), norms)):
        got, want = of(got), of(want)
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert {r.t for r in rows.select("t").distinct().collect()} == set(times)
    assert g.all_answers.where("t = 7").count() == last.count()


def test_gradient_sums_read_arrays_whole():
    rng = np.random.default_rng(1)
    n, width, kmax = 40_000, 80, 8
    x, y = rng.random((n, width)), rng.integers(0, kmax + 1, n).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(y)], ["features", "label"])
    model = features.Predictor.untrained(kmax, width)
    began = time.process_time()
    got = list(features._sums(iter([batch]), model, np.ones(kmax), True))[0]
    assert time.process_time() - began < 2  # row by row it took 5 s
    part = [list(features._sums(iter([batch.slice(a, z - a)]), model, np.ones(kmax), True))[0] for a, z in ((0, 7), (7, n))]
    for c in range(3):
        assert got.column(c)[0].as_py() == pytest.approx(sum(p.column(c)[0].as_py() for p in part))
