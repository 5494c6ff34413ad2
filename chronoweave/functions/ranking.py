"""Scores of pairs and how well they rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept


def running(rows: DataFrame, order: str, *values: str, ascending: bool = True) -> DataFrame:
    """`rows` with `before_x` for each value x: its sum over the rows before in `order`, which has no ties.

    A range sort; each partition adds up its own rows, and only partitions' totals go through one task.
    """
    by = F.col(order).asc() if ascending else F.col(order).desc()
    part = kept(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = part.groupBy("part").agg(*(F.sum(v).alias(v) for v in values))
    totals = totals.select("part", *(F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"base_{v}") for v in values))
    part = part.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"in_{v}") for v in values)).join(totals, "part")
    return part.select(*rows.columns, *((F.col(f"base_{v}") + F.col(f"in_{v}")).alias(f"before_{v}") for v in values))


def by_score(rows: DataFrame, score: str, label: str, times: str | None = None) -> DataFrame:
    """(s, n, p): rows and true rows of each score; `times` names a column of how many rows a row stands for."""
    one = F.col(times) if times else F.lit(1).cast("long")
    return rows.groupBy(F.col(score).alias("s")).agg(F.sum(one).alias("n"), F.coalesce(F.sum(F.when(F.col(label), one)), F.lit(0)).alias("p"))


def auc(rows: DataFrame, score: str, label: str, times: str | None = None) -> DataFrame:
    """(auc) of yes-or-no labels by sums of mean ranks; null if a label is missing. Rows are counted by score first."""
    n = by_score(rows, score, label, times)
    n = running(n, "s", "n").withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    t = n.agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"), F.sum(F.col("rank") * F.col("p")).alias("r"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, times: str | None = None) -> DataFrame:
    """(ap): precision at each score that adds true rows, weighted by how many; equal scores are taken together."""
    n = by_score(rows, score, label, times)
    n = running(n, "s", "n", "p", ascending=False)
    n = n.select("p", ((F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))).alias("precision"))
    return n.agg((F.sum(F.col("p") * F.col("precision")) / F.sum("p")).alias("ap"))


def both_ways(score_uv: Column, score_vu: Column) -> Column:
    """An undirected score from a directed one."""
    return (score_uv + score_vu) / 2


def project(nodes: DataFrame, vector: str, weights: list[list[float]], name: str) -> DataFrame:
    """`nodes` with `name`: the vector times each row of weights."""
    rows = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for w in weights]
    return nodes.withColumn(name, F.array(*rows))


def pair_decoder(pairs: DataFrame, nodes: DataFrame, left: list[list[float]], right: list[list[float]], bias: list[float], out: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """`pairs` (*by, u, v) with `score`: sigmoid(out . relu(left x_u + right x_v + bias)).

    The first layer is split by sides and computed once for each node, before the joins, so a pair only adds two short vectors.
    """
    a = project(nodes, "vector", left, "a").select(*by, F.col("node").alias("u"), "a")
    b = project(nodes, "vector", right, "b").select(*by, F.col("node").alias("v"), "b")
    rows = pairs.join(a, [*by, "u"]).join(b, [*by, "v"])
    hidden = F.zip_with(F.zip_with("a", "b", lambda x, y: x + y), F.array(*map(F.lit, bias)), lambda x, y: F.greatest(x + y, F.lit(0.0)))
    z = F.aggregate(F.zip_with(hidden, F.array(*map(F.lit, out)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*pairs.columns, (1 / (1 + F.exp(-z))).alias("score"))
