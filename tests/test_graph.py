import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.functions import ordinal, sets
from chronoweave.operators import communities, cores, edge_generation, history, influence, samples, snapshots, structure
from chronoweave.sources import edge_log


def log(spark, rows):
    return spark.createDataFrame([(u, v, t, i) for i, (u, v, t) in enumerate(rows)], "u long, v long, ts long, ord long")


def edges_of(spark, by_t):
    return spark.createDataFrame([(t, u, v) for t, es in by_t.items() for u, v in es], "t int, u long, v long")


def test_windows_overlap_and_gap(spark):
    e = log(spark, [(1, 2, 10), (1, 2, 15), (1, 2, 30), (1, 2, 31)])
    rows = snapshots.windows(e, 10, 20).orderBy("t").collect()
    assert [(r.start_ts, r.end_ts, r.edge_count) for r in rows] == [(-8, 12, 1), (2, 22, 2), (12, 32, 3)]
    e = log(spark, [(1, 2, 1), (1, 2, 10), (1, 2, 40)])
    rows = snapshots.windows(e, 30, 5).orderBy("t").collect()
    assert [(r.start_ts, r.end_ts, r.edge_count) for r in rows] == [(6, 11, 1), (36, 41, 1)]
    with pytest.raises(ValueError):
        snapshots.windows(e, 10, 100)


def test_window_assignment_equals_intervals(spark):
    r = random.Random(2)
    for step, window in ((7, 20), (20, 7), (5, 5)):
        times = sorted(r.randrange(0, 300) for _ in range(40))
        e = log(spark, [(1, 2, t) for t in times])
        s0, n, _, _ = snapshots.window_plan(e, step, window)
        got = sorted((x.window_index, x.ts) for x in snapshots.assign_windows(e, s0, n, step, window).collect())
        assert got == sorted((i, t) for i in range(n) for t in times if s0 + i * step <= t < s0 + i * step + window)


def test_snapshot_keeps_loop_nodes(spark):
    m = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 3)], "t int, u long, v long")
    e, n = snapshots.snapshot_edges(m), snapshots.snapshot_nodes(m)
    assert [(r.u, r.v) for r in e.collect()] == [(1, 2)]
    got = {r.node: r.core for r in cores.with_core(n, cores.coreness(e)).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


K4 = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_k4_with_a_tail(spark):
    e = edges_of(spark, {0: [*K4, (4, 5)]})
    core = cores.with_core(snapshots.snapshot_nodes(e), cores.coreness(e))
    state = structure.node_state(e, core)
    got = {r.node: (r.degree, r.h1, r.core) for r in state.collect()}
    assert got == {1: (3, 3, 3), 2: (3, 3, 3), 3: (3, 3, 3), 4: (4, 3, 3), 5: (1, 1, 1)}
    assert {(r.k, r.component_id, r.node) for r in cores.kcore_components(cores.edge_cores(e, core)).collect()} == {(3, 1, n) for n in (1, 2, 3, 4)}
    s = {(r.block, r.bucket): r.share for r in structure.structure(e, state, 3).where("node = 5").collect()}
    assert s == {(b, k): 0.5 for b in structure.BLOCKS for k in (1, 3)}
    v = {r.node: r.dist for r in structure.structure_vectors(structure.structure(e, state, 3), 3).collect()}
    assert len(v[5]) == 16 and v[5][1] == 0.5 and sum(structure.absent_vector(3)) == 4


def test_k8_is_a_seven_core(spark):
    e = edges_of(spark, {0: [(a, b) for a in range(8) for b in range(a + 1, 8)]})
    got = cores.kcore_components(cores.edge_cores(e, cores.coreness(e))).where("k = 7").collect()
    assert len(got) == 8 and {r.component_id for r in got} == {0}


def random_edges(seed, n=40, m=140):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def test_kernel_equals_joins(spark):
    e = edges_of(spark, {0: random_edges(1), 1: random_edges(2, 30, 60), 2: [(1, 2)]})
    a = {(r.t, r.node): r.core for r in cores.coreness(e).collect()}
    b = {(r.t, r.node): r.core for r in cores.coreness(e, kernel_edges=0).collect()}
    assert a == b
    c = {(r.t, r.node): r.component_id for r in cores.connected(e, ["t"]).collect()}
    assert c == {(r.t, r.node): r.component_id for r in cores.connected(e, ["t"], 0).collect()}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 14), st.integers(0, 14)).filter(lambda x: x[0] < x[1]), min_size=1))
def test_peel_is_maximal(es):
    u, v = np.array(sorted(es)).T
    nodes, core = cores.peel(u, v)
    own = dict(zip(nodes.tolist(), core.tolist()))
    for k in range(1, max(own.values()) + 2):
        alive = set(own)
        while True:
            gone = {n for n in alive if sum((a == n and b in alive) or (b == n and a in alive) for a, b in es) < k}
            if not gone:
                break
            alive -= gone
        assert alive == {n for n, c in own.items() if c >= k}


def test_signatures(spark):
    rows = spark.createDataFrame([(0, 1, 2), (2, 1, 3), (1, 9, 1)], "t int, node long, core int")
    got = {(r.node, r.k): r.value for r in history.signatures(rows, 2, 3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == pytest.approx([1.096651, 0.832572, 0.605784], abs=1e-6)
    state = spark.createDataFrame([], "node long, last_t int, sums array<double>")
    for t in range(3):
        state = history.advance(state, rows.where(F.col("t") == t), t, 3)
    step = {r.node: list(r.vec) for r in history.read_state(state, 2).collect()}
    assert step[1] == pytest.approx([got[1, k] for k in (1, 2, 3)]) and step[9] == pytest.approx([got[9, k] for k in (1, 2, 3)])
    with pytest.raises(ValueError):
        history.read_state(state, 1)


def test_influence_by_hand(spark):
    e = edges_of(spark, {0: [(1, 2)], 1: [(2, 3)]})
    *_, (_, state, _n) = influence.stream(e, [0, 1])
    got = {(r.src, r.node, r.time): (round(r.score, 6), round(r.weight, 6)) for r in influence.top_answers(state).collect()}
    assert got == {(1, 2, 0): (0.21, 1.0), (2, 3, 1): (0.14, 0.666667), (2, 1, 0): (0.07, 0.333333), (3, 2, 1): (0.21, 0.588235), (3, 1, 0): (0.147, 0.411765)}
    with pytest.raises(ValueError):
        list(influence.stream(e, [1, 0]))


def test_unbounded_stream_equals_walk(spark):
    e = edges_of(spark, {t: random_edges(10 + t, 9, 10) for t in range(4)}).persist()
    *_, (_, state, _n) = influence.stream(e, [0, 1, 2, 3], top=None, least=0.0)
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    want = {(r.src, r.node, r.time): r.score for r in influence.exact(e, nodes, 3).collect()}
    got = {(r.src, r.node, r.time): r.score for r in state.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_search_layers(spark):
    e = edges_of(spark, {0: [(1, 2), (2, 3), (3, 4), (4, 5)]})
    pred = spark.createDataFrame([(0, n, p) for n, p in zip((1, 2, 3, 4, 5), (3, 3, 1, 3, 3))], "t int, node long, pred int")
    q = spark.createDataFrame([(1, 3, 0)], "query long, k int, t int")
    seen, layers = communities.threshold_bfs(q, e, pred)
    assert {r.node for r in seen.where("inside").collect()} == {1, 2} and seen.count() == 3 and layers.first().layers == 3
    own = {r.node: r.component_id for r in communities.cumulative_components(pred, e, (3,)).where("t = 0").collect()}
    assert own == {1: 1, 2: 1, 4: 4, 5: 4}


def test_set_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([], []), ([1], []), ([], [1])], "p array<int>, t array<int>")
    got = [[round(x, 6) for x in r] for r in df.select(*sets.set_metrics(F.col("p"), F.col("t")).values()).collect()]
    assert got == [[0.666667, 0.5, 0.571429, 0.4], [1, 1, 1, 1], [0, 0, 0, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize(
    "cores_, scores, k, edges, cases, lowered, updates, again",
    [
        ({1: 3, 2: 3, 3: 3, 4: 3}, {a: {b: 0.5 for b in (1, 2, 3, 4)} for a in (1, 2, 3, 4)}, 3, K4, (6, 0, 0), [], 4, 0),
        ({1: 2, 2: 2, 3: 2}, {1: {2: 0.5}, 2: {3: 0.4}}, 1, [(1, 2), (1, 3), (2, 3)], (0, 0, 3), [], 3, 0),
        ({1: 2, 2: 2}, {1: {2: 0.5}, 2: {1: 0.5}}, 1, [(1, 2)], (0, 0, 1), [(1, 2, 1), (2, 2, 1)], 5, 3),
    ],
)
def test_edge_generation(cores_, scores, k, edges, cases, lowered, updates, again):
    g = edge_generation.generate(cores_, scores, k)
    assert sorted(g.edges) == edges and tuple(list(g.edges.values()).count(i) for i in (1, 2, 3)) == cases
    assert (g.lowered, g.updates, g.reprocessed) == (lowered, updates, again)


def test_edge_generation_stays_inside():
    r = random.Random(4)
    for seed in range(40):
        n = r.randint(2, 14)
        scores = {a: {b: r.choice([0.1, 0.2, r.random()]) for b in r.sample(range(n), r.randint(0, n - 1))} for a in range(n)}
        g = edge_generation.generate({a: r.randint(0, 5) for a in range(n)}, scores, 2)
        assert all(0 <= a < b < n and c in (1, 2, 3) for (a, b), c in g.edges.items()) and len(g.cores) == n


def test_splits_and_ordinals(spark):
    assert samples.split_bounds(30) == (20, 25) and samples.split_bounds(30, 0.55, 0.15) == (15, 21)
    with pytest.raises(ValueError):
        samples.split_bounds(3)
    df = spark.range(5).select(F.col("id").cast("int").alias("c"))
    logits = ordinal.cumulative_logits(ordinal.persistence_logits(F.col("c"), 6), 6)
    assert [r.x for r in df.select(ordinal.decode(logits).alias("x")).collect()] == [0, 1, 2, 3, 4]
    q = spark.createDataFrame([(i, 3, 0, False) for i in range(5)] + [(i, 4, 0, False) for i in range(3)] + [(i, 5, 0, True) for i in range(2)], "query long, k int, t int, empty boolean")
    n = {r["k"]: r["count"] for r in samples.stratified_downsample(q, 0.5).groupBy("k").count().collect()}
    assert sum(n.values()) == 5 and n[5] == 1 and n[3] in (2, 3)


def test_sources(spark, tmp_path):
    e = log(spark, [(1, 2, 5), (2, 3, 5), (1, 3, 9)])
    edge_log.write_edges_csv(e, f"{tmp_path}/log")
    back = edge_log.read_edges_csv(spark, f"{tmp_path}/log")
    assert sorted((r.u, r.v, r.ts) for r in back.collect()) == [(1, 2, 5), (1, 3, 9), (2, 3, 5)]
    assert edge_log.source_files(back).count() >= 1
    with pytest.raises(Exception):
        edge_log.write_edges_csv(e, f"{tmp_path}/log")
    (tmp_path / "bad.csv").write_text("u,v,ts\n1,2,x\n")
    assert edge_log.bad_records(spark, f"{tmp_path}/bad.csv").count() == 1
    with pytest.raises(Exception):
        edge_log.read_edges_csv(spark, f"{tmp_path}/bad.csv").collect()
    (tmp_path / "raw.txt").write_text("# c\n\n 1  2\t7.5\n3 4 -0.5\n")
    raw = edge_log.read_raw(spark, f"{tmp_path}/raw.txt", "txt")
    assert [(r.u, r.v, r.ts) for r in edge_log.standardise(raw).orderBy("ord").collect()] == [(1, 2, 7), (3, 4, -1)]
    (tmp_path / "coin.csv").write_text("day,src,dst,value\n3,x,y,1\n4,z,x,1\n")
    assert [(r.u, r.v) for r in edge_log.read_raw(spark, f"{tmp_path}/coin.csv", "coin").orderBy("ord").collect()] == [(0, 1), (2, 0)]
    with pytest.raises(ValueError):
        edge_log.require_sorted(log(spark, [(1, 2, 5), (1, 2, 4)]))
    m = snapshots.manifest(e, "toy", 2, 3)
    edge_log.write_manifest(spark, m, f"{tmp_path}/manifest")
    assert edge_log.load_manifest(spark, f"{tmp_path}/manifest") == m
    edge_log.publish({"edges": e}, f"{tmp_path}/store")
    edge_log.publish({"edges": e.limit(1)}, f"{tmp_path}/store")
    assert edge_log.published(spark, f"{tmp_path}/store", "edges").count() == 1
