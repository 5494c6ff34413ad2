"""Publishing, rolling back, changed sources, and what fails aloud."""

import time

import numpy as np
import pytest

from chronoweave.operators import communities, cores, evaluation, samples, snapshots
from chronoweave.sources import edge_log


def test_generations(spark, tmp_path):
    root, df = f"{tmp_path}/store", spark.range(5)
    with pytest.raises(ValueError):
        edge_log.published(spark, root, "a")
    for n in (5, 4, 3):
        edge_log.publish({"a": df.limit(n), "b": df}, root)
    assert edge_log.published(spark, root, "a").count() == 3 and len(edge_log.generations(spark, root)) == 3
    edge_log.roll_back(spark, root)
    assert edge_log.published(spark, root, "a").count() == 4
    edge_log.publish({"a": df.limit(1)}, root, keep=2)
    assert [n for n, _ in edge_log.generations(spark, root)] == [1, 2] and edge_log.published(spark, root, "a").count() == 1


def test_a_failed_generation_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/store"
    edge_log.publish({"a": spark.range(5)}, root)
    with pytest.raises(Exception):
        edge_log.publish({"a": spark.range(3), "b": spark.range(3).selectExpr("raise_error('no')")}, root)
    assert edge_log.published(spark, root, "a").count() == 5
    assert len(list((tmp_path / "store" / "generations").iterdir())) == 1
    edge_log.write_text(spark, "x", f"{root}/published/0000000001", replace=False)  # another writer was faster
    with pytest.raises(FileExistsError):
        edge_log.write_text(spark, "y", f"{root}/published/0000000001", replace=False)


def test_changed_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text("u,v,ts\n1,2,3\n")
    before = spark.createDataFrame(edge_log.source_files(edge_log.read_edges_csv(spark, str(tmp_path))).collect())
    assert edge_log.changed_files(before, before).isEmpty()
    (tmp_path / "a.csv").write_text("u,v,ts\n1,2,3\n4,5,6\n")
    (tmp_path / "b.csv").unlink()
    (tmp_path / "d.csv").write_text("u,v,ts\n1,2,3\n")
    spark.catalog.refreshByPath(str(tmp_path))
    now = edge_log.source_files(edge_log.read_edges_csv(spark, str(tmp_path)))
    assert {(r.path.rsplit("/", 1)[-1], r.change) for r in edge_log.changed_files(now, before).collect()} == {("a.csv", "other"), ("b.csv", "gone"), ("d.csv", "new")}


def test_peel_follows_the_edges():
    """Many rounds cost no more than the edges they touch."""
    took = []
    for n in (20_000, 80_000):
        u = np.arange(n - 1)
        began = time.process_time()
        _, core = cores.peel(u, u + 1)
        took.append(time.process_time() - began)
        assert (core == 1).all()
    assert took[1] < 10 * took[0]


def test_dense_snapshot_is_an_error(spark):
    nodes = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "t int, node long")
    full = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 3)], "t int, u long, v long")
    with pytest.raises(ValueError):
        samples.negative_edges(full, nodes)
    two = samples.negative_edges(full.limit(2), nodes).collect()
    left = {(1, 2), (1, 3), (2, 3)} - {(r.u, r.v) for r in full.limit(2).collect()}
    assert len(two) == 2 and {(r.u, r.v) for r in two} == left


def test_threshold_is_strict_or_not(spark):
    q = spark.createDataFrame([(1, 2, 0)], "query long, k int, t int")
    cand = spark.createDataFrame([(1, 2, 0, n) for n in (1, 2, 3)], "query long, k int, t int, node long")
    scored = spark.createDataFrame([(1, 2, 0, 1, 2, 0.5), (1, 2, 0, 1, 3, 0.5), (1, 2, 0, 2, 3, 0.9), (1, 2, 0, 3, 9, 0.9)], "query long, k int, t int, u long, v long, score double")
    assert {r.node for r in communities.recover_components(q, cand, scored, 0.5).collect()} == {1, 2, 3}
    assert communities.recover_components(q, cand, scored, 0.5, strict=True).count() == 0
    assert communities.recover_components(q, cand.where("node <> 1"), scored, 0.5).count() == 0


def test_slices(spark, tmp_path):
    """Slices as files of their own, the same cut from one log, and the log made of them again."""
    rows = [(1, 2, 10), (1, 2, 15), (2, 3, 30), (3, 4, 31)]
    e = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "u long, v long, ts long, ord long")
    m = snapshots.manifest(e, "toy", 10, 20)
    edge_log.write_edges_csv(e, f"{tmp_path}/log")
    (tmp_path / "slices").mkdir()
    for k, x in enumerate(m["slices"]):
        (tmp_path / "slices" / f"slice_{k:06d}.csv").write_text("u,v,ts\n" + "".join(f"{u},{v},{t}\n" for u, v, t in rows if x["start_ts"] <= t < x["end_ts"]))
    files = sorted(map(tuple, edge_log.load_edges(spark, f"{tmp_path}/slices").collect()))
    assert files == sorted(map(tuple, edge_log.load_edges(spark, f"{tmp_path}/log", m).collect())) and len(files) == m["written_edge_count"]
    again = edge_log.migrate_slices(spark, f"{tmp_path}/slices", m, f"{tmp_path}/again")
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    m["slices"][1]["edge_count"] += 1
    with pytest.raises(ValueError):
        edge_log.migrate_slices(spark, f"{tmp_path}/slices", m, f"{tmp_path}/never")


def test_file_order(spark, tmp_path):
    """Records of several files are numbered by file and place, whatever the files' sizes."""
    sizes = {"a.csv": 50, "b.csv": 3000, "c.csv": 2}
    at = 0
    for name, n in sizes.items():
        (tmp_path / name).write_text("u,v,ts\n" + "".join(f"{at + i},{at + i + 1},{i}\n" for i in range(n)))
        at += n
    got = edge_log.read_raw(spark, str(tmp_path), "csv").orderBy("ord").collect()
    assert [r.u for r in got] == list(range(at)) and [r.ord for r in got] == list(range(at))


def test_kept_tables_know_what_they_are(spark, tmp_path):
    made = []

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    for n, model in ((3, "a"), (4, "a"), (5, "b")):
        df = evaluation.cached(spark, f"{tmp_path}/t=1", {"model": model, "t": 1}, make(n))
    assert made == [3, 5] and df.count() == 5
    rows, table = spark.range(2), spark.createDataFrame([(0, 1, "h1", 2, 0.5)] * 3, "t int, node long, block string, bucket int, share double")
    features, structure = evaluation.feature_store(spark, f"{tmp_path}/f", {"x": 1}, rows, table)
    assert features.count() == 2 and structure.count() == 1


def test_incremental_candidates(spark):
    kcore = spark.createDataFrame([(0, 3, 1, n) for n in (1, 2, 3)] + [(1, 3, 1, n) for n in (1, 4)] + [(1, 3, 5, n) for n in (5, 6)], "t int, k int, component_id long, node long")
    index, queries = spark.createDataFrame([], "query long, k int, node long"), spark.createDataFrame([(1, 3), (9, 3)], "query long, k int")
    for t, want in ((0, {1, 2, 3}), (1, {1, 2, 3, 4})):
        index = communities.extend_index(index, queries, kcore, t)
        assert [r.node for r in index.orderBy("node").collect()] == sorted(want)
