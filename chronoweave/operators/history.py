"""Temporal core signatures: decayed history of each node's coreness against every threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.7


def gain(k: Column, core: Column) -> Column:
    return F.when(core <= k, core / k).otherwise(2 - k / core)


def signatures(cores: DataFrame, t: int, kmax: int, alpha: float = ALPHA) -> DataFrame:
    """(node, k, value), k = 1..kmax, of every node seen up to t; snapshots a node isn't in add nothing."""
    total = (1 - alpha ** (t + 1)) / (1 - alpha)
    rows = cores.where(F.col("t") <= t).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax))))
    value = F.sum(F.pow(F.lit(alpha), F.lit(t) - F.col("t")) * gain(F.col("k"), F.col("core"))) / F.lit(total)
    return rows.groupBy("node", "k").agg(value.alias("value"))


def signature_vectors(cores: DataFrame, t: int, kmax: int, alpha: float = ALPHA) -> DataFrame:
    """(node, vec)."""
    s = F.array_sort(F.collect_list(F.struct("k", "value")))
    return signatures(cores, t, kmax, alpha).groupBy("node").agg(F.transform(s, lambda x: x["value"]).alias("vec"))


def advance(state: DataFrame, snapshot: DataFrame, t: int, kmax: int, alpha: float = ALPHA) -> DataFrame:
    """One step of the incremental form: (node, last_t, sums) after snapshot t of (node, core).

    sums are the decayed gains as of last_t; nodes that aren't in the snapshot keep theirs and decay when read.
    """
    gains = F.transform(F.sequence(F.lit(1), F.lit(kmax)), lambda k: gain(k, F.col("core")))
    new = snapshot.select("node", gains.alias("g"))
    both = state.join(new, "node", "full").withColumn("decay", F.pow(F.lit(alpha), F.lit(t) - F.col("last_t")))
    merged = F.when(F.col("g").isNull(), F.col("sums")).when(F.col("sums").isNull(), F.col("g")).otherwise(F.zip_with("sums", "g", lambda s, g: s * F.col("decay") + g))
    return both.select("node", F.when(F.col("g").isNull(), F.col("last_t")).otherwise(F.lit(t)).alias("last_t"), merged.alias("sums"))


def read_state(state: DataFrame, t: int, alpha: float = ALPHA) -> DataFrame:
    """(node, vec) of the incremental state as of t."""
    if not state.where(F.col("last_t") > t).isEmpty():
        raise ValueError("history only moves forward")
    total = (1 - alpha ** (t + 1)) / (1 - alpha)
    f = F.pow(F.lit(alpha), F.lit(t) - F.col("last_t")) / F.lit(total)
    return state.select("node", F.transform("sums", lambda s: s * f).alias("vec"))
