"""python -m chronoweave build | train | query | evaluate | score | check | restrict (see --help)"""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sets
from .operators import communities, cores, edge_generation, evaluation, features, influence, samples, snapshots, structure
from .session import local_session
from .sources import edge_log
from .tables import kept, shared_folder


def build(spark: SparkSession, log: str, out: str, step: int, window: int) -> dict:
    """Snapshots of a standardised log as a new generation of tables under `out`, and its manifest."""
    e = edge_log.read_edges_csv(spark, log).withColumn("ord", F.monotonically_increasing_id())
    m = snapshots.members(e, step, window)
    edges, nodes = snapshots.snapshot_edges(m), snapshots.snapshot_nodes(m)
    core = cores.with_core(nodes, cores.coreness(edges))
    kcore = cores.kcore_components(cores.edge_cores(edges, core))
    manifest = snapshots.manifest(e, log.rstrip("/").rsplit("/", 1)[-1], step, window)
    edge_log.publish({"edges": edges, "core": core, "kcore": kcore}, out)
    edge_log.write_manifest(spark, manifest, f"{out}/manifest")
    return {"snapshots": manifest["slice_count"], "edges": manifest["written_edge_count"]}


def _n(spark: SparkSession, out: str) -> int:
    return edge_log.load_manifest(spark, f"{out}/manifest")["slice_count"]


def _features(spark: SparkSession, out: str) -> tuple[DataFrame, dict]:
    """Whole features of all samples of a store, kept beside it, and what they were made of."""
    edges, core = edge_log.published(spark, out, "edges"), edge_log.published(spark, out, "core")
    n, state = _n(spark, out), kept(structure.node_state(edges, core))
    top = state.agg(F.max("core").alias("kmax"), F.max("h1").alias("hmax")).first()
    identity = {"generation": edge_log.generations(spark, out)[-1][1], "kmax": top.kmax, "hmax": top.hmax}
    shares = structure.structure(edges, state, top.hmax)

    def make() -> DataFrame:
        answers = kept(influence.answers_at(edges, None, list(range(n - 1))))
        return features.feature_rows(samples.coreness_samples(core, n), core, state, top.kmax, answers, shares, top.hmax, width=features.feature_width(top.kmax, top.hmax))

    return evaluation.cached(spark, f"{out}/features", identity, make), identity


def train(spark: SparkSession, out: str, model: str, epochs: int = features.Defaults.epochs, patience: int = features.Defaults.patience) -> dict:
    """Trains a predictor on a store's samples and saves it; gives its metrics on the test times beside those of staying."""
    rows, identity = _features(spark, out)
    m = features.fit_predictor(rows, identity["kmax"], features.Defaults(epochs=epochs, patience=patience), hmax=identity["hmax"])
    m.save(spark, model)
    test, result = rows.where("split = 'test'"), {}
    for name, one in (("trained", m), ("staying", features.Predictor.untrained(m.kmax, len(m.mean)))):
        found = one.predict(test).agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"), F.avg(F.abs(F.col("pred") - F.col("label"))).alias("mae"))
        result[name] = found.first().asDict()
    return result


def _predicted(spark: SparkSession, out: str, model: str | None) -> DataFrame:
    """(t, node, pred): coreness that stays as it is, or a saved predictor's."""
    if model is None:
        return edge_log.published(spark, out, "core").withColumnRenamed("core", "pred")
    rows, identity = _features(spark, out)
    m = features.Predictor.load(spark, model, kmax=identity["kmax"], width=features.feature_width(identity["kmax"], identity["hmax"]), hmax=identity["hmax"])
    return m.predict(rows).select(F.col("time").alias("t"), "node", "pred")


def _search(spark: SparkSession, out: str, queries: DataFrame, model: str | None = None) -> DataFrame:
    return communities.threshold_bfs(queries, edge_log.published(spark, out, "edges"), _predicted(spark, out, model))[0]


def query(spark: SparkSession, out: str, q: int, k: int, t: int, model: str | None = None, with_edges: bool = False) -> dict:
    """The community of q at t + 1, coreness staying as it is at t or as a saved predictor says, and with_edges the edges inside it."""
    seen = kept(_search(spark, out, spark.createDataFrame([(q, k, t)], "query long, k int, t int"), model))
    inside = seen.where("inside")
    result = {"query": q, "k": k, "t": t, "community": sorted(r.node for r in inside.collect()), "looked_at": seen.count(), "layers": seen.agg(F.max("layer")).first()[0]}
    if with_edges:
        answers = influence.answers_at(edge_log.published(spark, out, "edges"), None, [t])
        found = edge_generation.generate_edges(inside.select("query", "k", "t", "node", "pred"), answers.groupBy("t", "src", "node").agg(F.sum("score").alias("score")))
        result["edges"] = sorted([r.u, r.v, r.case] for r in found.where("u is not null").collect())
    return result


METRICS = ["precision", "recall", "f1", "jaccard"]


def evaluate(spark: SparkSession, out: str, model: str | None = None, results: str | None = None, batches: int | None = None) -> dict:
    """Metrics of the held-out cohort by k and their mean. Results are kept under `results`, where a stopped run goes on."""
    core, kcore = edge_log.published(spark, out, "core"), edge_log.published(spark, out, "kcore")
    n = _n(spark, out)
    cohort = kept(samples.cohort(kcore, core, n, samples.evaluation_start(n)).where("not empty"))

    def one(todo: DataFrame, t: int) -> DataFrame:
        rows = sets.counted(todo, _search(spark, out, todo, model).where("inside"), samples.truth_members(todo, kcore), evaluation.KEY, ["node"])
        m = sets.count_metrics(F.col("hit"), F.col("found"), F.col("true"))
        return rows.select(*evaluation.KEY, *(m[x].alias(x) for x in METRICS))

    root = results or f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}"
    return evaluation.summary(cohort, evaluation.resume(cohort, root, one, METRICS, batches), METRICS)


def score(spark: SparkSession, out: str, u: int, v: int, t: int) -> dict:
    """The built-in scorer's opinion of one pair at t + 1."""
    pair = spark.createDataFrame([(u, 0, t, min(u, v), max(u, v))], "query long, k int, t int, u long, v long")
    found = communities.recency_score(pair, edge_log.published(spark, out, "edges")).first()
    return {"u": u, "v": v, "t": t, "score": found.score if found else 0.0}


def check(spark: SparkSession, out: str) -> dict:
    """Whether a store's tables fit its manifest and one another."""
    m, faults = edge_log.load_manifest(spark, f"{out}/manifest"), []
    edges, core, kcore = (edge_log.published(spark, out, x) for x in ("edges", "core", "kcore"))
    if {r.t for r in core.select("t").distinct().collect()} != set(range(m["slice_count"])):
        faults.append("core has other snapshots than the manifest")
    ends = edges.select("t", F.explode(F.array("u", "v")).alias("node"))
    if not ends.join(core, ["t", "node"], "left_anti").isEmpty():
        faults.append("an edge has an end without a coreness")
    if not edges.where("u >= v").isEmpty() or not edges.groupBy("t", "u", "v").count().where("count > 1").isEmpty():
        faults.append("edges aren't simple")
    if not kcore.join(core, ["t", "node"], "left").where("core is null or core < k").isEmpty():
        faults.append("a node is in a core over its coreness")
    return {"slices": m["slice_count"], "faults": faults}


def restrict(spark: SparkSession, out: str, ks: list[int]) -> dict:
    """A new generation with the components of some k only."""
    tables = {x: edge_log.published(spark, out, x) for x in ("edges", "core", "kcore")}
    tables["kcore"] = tables["kcore"].where(F.col("k").isin(ks))
    return {"generation": edge_log.publish(tables, out), "ks": ks}


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="chronoweave")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("log")
    b.add_argument("out")
    b.add_argument("--step", type=int, default=snapshots.STEP)
    b.add_argument("--window", type=int, default=snapshots.WINDOW)
    d = features.Defaults()
    b = sub.add_parser("train")
    b.add_argument("out")
    b.add_argument("model")
    b.add_argument("--epochs", type=int, default=d.epochs)
    b.add_argument("--patience", type=int, default=d.patience)
    c = sub.add_parser("query")
    c.add_argument("out")
    for name in ("q", "k", "t"):
        c.add_argument(name, type=int)
    c.add_argument("--model")
    c.add_argument("--with-edges", action="store_true")
    c = sub.add_parser("evaluate")
    c.add_argument("out")
    c.add_argument("--model")
    c.add_argument("--results")
    c.add_argument("--batches", type=int)
    c = sub.add_parser("score")
    c.add_argument("out")
    for name in ("u", "v", "t"):
        c.add_argument(name, type=int)
    sub.add_parser("check").add_argument("out")
    c = sub.add_parser("restrict")
    c.add_argument("out")
    c.add_argument("ks", type=int, nargs="+")
    a = vars(p.parse_args(args))
    run = {"build": build, "train": train, "query": query, "evaluate": evaluate, "score": score, "check": check, "restrict": restrict}[a.pop("command")]
    result = run(local_session(), **a)
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
