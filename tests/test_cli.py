from chronoweave import __main__ as cli
from chronoweave.sources import edge_log


def test_build_query_evaluate(spark, tmp_path):
    edge_log.write_edges_csv(edge_log.event_edges(spark, "/root/testdata/sf0.001"), f"{tmp_path}/log")
    out = f"{tmp_path}/store"
    assert cli.main(["build", f"{tmp_path}/log", out]) == {"snapshots": 30, "edges": cli.edge_log.load_manifest(spark, f"{out}/manifest")["written_edge_count"]}
    core = edge_log.published(spark, out, "core")
    q = core.where("t = 20 and core >= 4").orderBy("node").first().node
    got = cli.main(["query", out, str(q), "4", "20"])
    assert q in got["community"] and got["looked_at"] >= len(got["community"])
    result = cli.main(["evaluate", out])
    assert set(result["per_k"]) <= {3, 4, 5, 6, 7} and 0 <= result["macro"]["f1"] <= 1
    assert cli.main(["check", out]) == {"slices": 30, "faults": []}
    # stopped after one batch, gone on with, and the same as at once
    part = cli.main(["evaluate", out, "--results", f"{tmp_path}/r", "--batches", "1"])
    assert part["macro"] is None and not part["complete"]
    assert "| all |" in (tmp_path / "r" / "status.md").read_text()
    assert cli.main(["evaluate", out, "--results", f"{tmp_path}/r"]) == result
    u, v = edge_log.published(spark, out, "edges").where("t = 20").select("u", "v").first()
    assert 0.5 <= cli.main(["score", out, str(v), str(u), "20"])["score"] <= 1 and cli.main(["score", out, "-5", "-6", "20"])["score"] == 0
    trained = cli.main(["train", out, f"{tmp_path}/model.json", "--epochs", "3"])
    assert trained["trained"]["accuracy"] >= trained["staying"]["accuracy"] - 0.1
    found = cli.main(["query", out, str(q), "4", "20", "--model", f"{tmp_path}/model.json", "--with-edges"])
    assert found["query"] == q and all(a in found["community"] and b in found["community"] for a, b, _ in found["edges"])
    cli.main(["restrict", out, "3", "4"])
    assert {r.k for r in edge_log.published(spark, out, "kcore").select("k").distinct().collect()} <= {3, 4}


def test_check_finds_faults(spark, tmp_path):
    out = f"{tmp_path}/store"
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "t int, u long, v long")
    core = spark.createDataFrame([(0, 1, 1)], "t int, node long, core int")
    kcore = spark.createDataFrame([(0, 3, 1, 1)], "t int, k int, component_id long, node long")
    edge_log.publish({"edges": edges, "core": core, "kcore": kcore}, out)
    slices = {"dataset": "x", "step_seconds": 1, "window_seconds": 1, "first_timestamp": 0, "last_timestamp": 1, "observation_end": 2, "window_alignment": "right", "planned_slice_count": 2, "slice_count": 2, "slices": [{}, {}]}
    edge_log.write_manifest(spark, slices, f"{out}/manifest")
    assert len(cli.check(spark, out)["faults"]) == 4
