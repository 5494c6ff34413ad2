"""Evaluations that can be stopped and resumed, their reports, and tables kept for a time and looked at before use."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edge_log import _fs, read_text, write_text
from .features import pending, progress

KEY = ["query", "k", "t"]


def finished(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Results of all batches that were written to their end."""
    at, fs = _fs(spark, f"{root}/results")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    paths = [f"{root}/results/{n}" for n in names if fs.exists(_fs(spark, f"{root}/results/{n}/_SUCCESS")[0])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def resume(cohort: DataFrame, root: str, evaluate: Callable[[DataFrame, int], DataFrame], metrics: list[str], batches: int | None = None) -> DataFrame:
    """Evaluates a cohort (query, k, t) time by time and gives the results (query, k, t, *metrics) so far.

    evaluate(samples, t) gives the results of the samples of one time that have none yet. They are written as a table of
    their own and count once that is whole, so a run that stops, wherever it does, goes on where it was; the status is
    written after each batch. batches: stop after so many.
    """
    spark = cohort.sparkSession
    schema = "query long, k int, t int, " + ", ".join(f"`{m}` double" for m in metrics)
    for t in sorted(r.t for r in cohort.select("t").distinct().collect()):  # one batch for each evaluation time
        if batches is not None and batches <= 0:
            break
        todo = pending(cohort.where(F.col("t") == t), finished(spark, root, schema)).select(*KEY)
        if todo.isEmpty():
            continue
        rows = evaluate(todo, t).select(*KEY, *(F.col(m).cast("double").alias(m) for m in metrics))
        rows.write.mode("overwrite").parquet(f"{root}/results/t={t}-{finished(spark, root, schema).count()}")
        batches = None if batches is None else batches - 1
        report(cohort, finished(spark, root, schema), metrics, f"{root}/status")
    return finished(spark, root, schema)


def summary(cohort: DataFrame, done: DataFrame, metrics: list[str]) -> dict:
    """How far each k is, its means once it is whole, and the means over all k once they all are."""
    per_k: dict[int, dict] = {}
    for m in metrics:
        for r in progress(cohort, done, m).collect():  # one row for each k
            of = per_k.setdefault(r.k, {"total": r.total, "completed": r.completed})
            of[m] = r.value if r.completed == r.total else None
    whole = bool(per_k) and all(p["completed"] == p["total"] for p in per_k.values())
    macro = {m: sum(p[m] for p in per_k.values()) / len(per_k) for m in metrics} if whole else None
    return {"per_k": {k: per_k[k] for k in sorted(per_k)}, "macro": macro, "complete": whole}


def markdown(found: dict, metrics: list[str]) -> str:
    """The same as a table; what isn't known yet is a dash."""
    cell = lambda v: "-" if v is None else f"{v:.4f}"
    lines = ["| k | done | " + " | ".join(metrics) + " |", "| --- " * (len(metrics) + 2) + "|"]
    lines += [f"| {k} | {p['completed']}/{p['total']} | " + " | ".join(cell(p[m]) for m in metrics) + " |" for k, p in found["per_k"].items()]
    lines.append("| all | | " + " | ".join(cell(found["macro"] and found["macro"][m]) for m in metrics) + " |")
    return "\n".join(lines) + "\n"


def report(cohort: DataFrame, done: DataFrame, metrics: list[str], path: str) -> dict:
    """Writes path.json and path.md, each whole or not at all, and gives the summary."""
    found = summary(cohort, done, metrics)
    write_text(cohort.sparkSession, json.dumps(found, sort_keys=True), f"{path}.json")
    write_text(cohort.sparkSession, markdown(found, metrics), f"{path}.md")
    return found


def cached(spark: SparkSession, path: str, identity: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path` if it was made under the same `identity` (model, time, input); else `make()` is written there first.

    The identity is written last, so a table without one, or with another, is never used.
    """
    said = json.dumps(identity, sort_keys=True)
    at, fs = _fs(spark, f"{path}/identity.json")
    if not (fs.exists(at) and read_text(spark, f"{path}/identity.json").strip() == said):
        whole, _ = _fs(spark, path)
        fs.delete(whole, True)
        make().write.parquet(f"{path}/table")
        write_text(spark, said, f"{path}/identity.json")
    return spark.read.parquet(f"{path}/table")


def feature_store(spark: SparkSession, root: str, identity: dict, rows: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature rows by split, and the structures they refer to once each, both kept under one identity."""
    return cached(spark, f"{root}/features", identity, lambda: rows), cached(spark, f"{root}/structure", identity, lambda: table.dropDuplicates(["t", "node", "block", "bucket"]))
