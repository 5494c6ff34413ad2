import pytest
from pyspark.sql import functions as F

from chronoweave.operators import history, influence
from chronoweave.streaming import state

ROWS = [(0, 1, 2), (0, 2, 1), (1, 2, 3), (2, 1, 3), (2, 3, 1), (3, 2, 2)]


def feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_signatures_follow_the_stream(spark, tmp_path):
    source = feed(spark, tmp_path / "in", [[r for r in ROWS if r[0] == t] for t in range(4)] + [[(1, 5, 9)]], state.CORES)
    q = state.follow_signatures(source, f"{tmp_path}/out", 3, f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    t = state.latest(spark, f"{tmp_path}/out/state")
    assert t == 3 and state.latest(spark, f"{tmp_path}/out/state", 2) == 2
    got = {r.node: list(r.vec) for r in history.read_state(spark.read.parquet(f"{tmp_path}/out/state/t=3"), 3).collect()}
    want = {r.node: list(r.vec) for r in history.signature_vectors(spark.createDataFrame(ROWS, state.CORES), 3, 3).collect()}
    assert set(got) == set(want) and all(got[n] == pytest.approx(want[n]) for n in want)
    assert [(r.t, r.node) for r in spark.read.parquet(f"{tmp_path}/out/late").collect()] == [(1, 5)]
    state.drop_old_states(spark, f"{tmp_path}/out/state", 1)
    assert state.latest(spark, f"{tmp_path}/out/state", 2) is None


def test_signatures_by_key(spark, tmp_path):
    source = feed(spark, tmp_path / "in", [[r for r in ROWS if r[0] == t] for t in range(4)], state.CORES)
    q = state.signatures_by_key(source, 3).writeStream.format("memory").queryName("by_key").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.node, r.t): list(r.vec) for r in spark.table("by_key").collect()}
    want = {r.node: list(r.vec) for r in history.signature_vectors(spark.createDataFrame(ROWS, state.CORES), 3, 3).collect()}
    assert got[2, 3] == pytest.approx(want[2]) and len(got) == len(ROWS)


def test_influence_follows_the_stream(spark, tmp_path):
    rows = [(0, 1, 2), (0, 2, 3), (1, 1, 3), (2, 2, 3)]
    schema = "t int, u long, v long"
    source = feed(spark, tmp_path / "in", [[r for r in rows if r[0] == t] for t in range(3)], schema)
    state.follow_influence(source, f"{tmp_path}/out", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    *_, (_, want, _n) = influence.stream(spark.createDataFrame(rows, schema), [0, 1, 2])
    key = lambda df: {(r.src, r.node, r.time): round(r.score, 12) for r in df.collect()}
    assert key(spark.read.parquet(f"{tmp_path}/out/state/t=2")) == key(want)


def test_window_counts(spark, tmp_path):
    rows = [(1, 2, t) for t in (100, 105, 131, 160, 400)]
    source = feed(spark, tmp_path / "in", [rows], "u long, v long, ts long")
    q = state.window_counts(source, 10, 20, 40).writeStream.format("memory").queryName("wc").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start_ts, r.end_ts): r.edge_count for r in spark.table("wc").where(F.col("end_ts") <= 300).collect()}
    want = {}
    for s in range(10, 300, 20):
        n = sum(s <= t < s + 40 for _, _, t in rows)
        if n and s + 40 <= 300:
            want[s, s + 40] = n
    assert got == want
