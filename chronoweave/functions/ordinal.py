"""Ordinal targets, logits and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordinal_targets(label: Column, kmax: int) -> Column:
    """1 for each threshold k = 1..kmax that the label reaches."""
    return F.transform(F.sequence(F.lit(1), F.lit(kmax)), lambda k: (label >= k).cast("int"))


def persistence_logits(core: Column, kmax: int, scale: float = 2.0) -> Column:
    """-scale * |j - core| for classes j = 0..kmax."""
    return F.transform(F.sequence(F.lit(0), F.lit(kmax)), lambda j: -F.lit(scale) * F.abs(j - core))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def cumulative_logits(logits: Column, kmax: int) -> Column:
    """For k = 1..kmax the log odds that the class is at least k."""
    return F.transform(F.sequence(F.lit(1), F.lit(kmax)), lambda k: log_sum_exp(F.slice(logits, k + 1, F.lit(kmax) + 1 - k)) - log_sum_exp(F.slice(logits, F.lit(1), k)))


def decode(cumulative: Column) -> Column:
    """The number of thresholds whose log odds are over 0."""
    return F.size(F.filter(cumulative, lambda x: x > 0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / total)


def positive_weights(labels: DataFrame, label: str, kmax: int, power: float = 0.5, cap: float = 10.0) -> DataFrame:
    """(k, weight): (negatives / positives)^power up to cap where negatives outnumber positives, else 1."""
    if not 0 <= power <= 1 or cap < 1:
        raise ValueError("power is 0 to 1, cap at least 1")
    rows = labels.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax)))).groupBy("k")
    n = rows.agg(F.count_if(F.col(label) >= F.col("k")).alias("p"), F.count_if(F.col(label) < F.col("k")).alias("n"))
    w = F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), F.least(F.pow(F.col("n") / F.col("p"), F.lit(power)), F.lit(cap))).otherwise(F.lit(1.0))
    return n.select("k", w.alias("weight"))
