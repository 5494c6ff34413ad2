"""Features of coreness samples, and predictors trained on them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordinal
from ..sources.edge_log import read_text, write_text
from ..tables import kept
from . import history, influence
from .samples import core_history
from .structure import BLOCKS


def signatures_at(samples: DataFrame, cores: DataFrame, kmax: int, alpha: float = history.ALPHA) -> DataFrame:
    """(node, time, k, value): core signatures as of each sample's own time. A node's samples meet its past once each."""
    rows = samples.select("node", "time").join(cores.select("node", "t", "core"), "node").where("t <= time")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax))))
    total = (1 - F.pow(F.lit(alpha), F.col("time") + 1)) / F.lit(1 - alpha)
    value = F.sum(F.pow(F.lit(alpha), F.col("time") - F.col("t")) * history.gain(F.col("k"), F.col("core")))
    return rows.groupBy("node", "time", "k").agg(value.alias("x")).select("node", "time", "k", (F.col("x") / total).alias("value"))


def influence_features(answers: DataFrame, shares: DataFrame, hmax: int) -> DataFrame:
    """(node, time, place, value): of each query (src, t) of `answers` the weighted structure of its influences, places block
    by block and bucket by bucket, and last the weighted log age. Queries without influences have no row."""
    key = ("src", "t")
    block = F.array_position(F.array(*map(F.lit, BLOCKS)), F.col("block")) - 1
    place = (block * (hmax + 1) + F.least(F.col("bucket"), F.lit(hmax))).cast("int")
    rows = influence.weighted_structure(answers, shares, by=key).select(*key, place.alias("place"), "value")
    age = influence.log_ages(answers).groupBy(*key).agg(F.sum(F.col("weight") * F.col("age")).alias("value"))
    rows = rows.union(age.select(*key, F.lit(len(BLOCKS) * (hmax + 1)), "value"))
    return rows.select(F.col("src").alias("node"), F.col("t").alias("time"), "place", "value")


def structure_table(answers: DataFrame, shares: DataFrame) -> DataFrame:
    """(t, node, block, bucket, share): the structure of every (node, time) that some answer refers to, once however many do."""
    used = answers.select(F.col("time").alias("t"), "node").distinct()
    return shares.join(used, ["t", "node"], "left_semi").select("t", "node", "block", "bucket", "share")


def feature_values(samples: DataFrame, cores: DataFrame, state: DataFrame, kmax: int, answers: DataFrame, shares: DataFrame, hmax: int, lookback: int = 5) -> DataFrame:
    """(node, time, place, value) of samples (node, time), zero values left out: coreness of the last `lookback` snapshots, core
    signature, degree and h-indexes now, weighted structure and age of the influences as of `time` (`answers` for every t)."""
    key = ["node", "time"]
    own = samples.select(*key).distinct()
    lags = core_history(own, cores, lookback).select(*key, F.col("lag").alias("place"), F.col("core").cast("double").alias("value"))
    sign = signatures_at(own, cores, kmax).select(*key, (F.col("k") - 1 + lookback).alias("place"), "value")
    at = lookback + kmax
    now = F.explode(F.array(*(F.struct(F.lit(at + i).alias("place"), F.col(c).cast("double").alias("value")) for i, c in enumerate(("degree", "h1", "h2", "h3")))))
    now = state.withColumnRenamed("t", "time").join(own, key, "left_semi").select(*key, now.alias("x")).select(*key, "x.place", "x.value")
    of = answers.join(own.select(F.col("node").alias("src"), F.col("time").alias("t")), ["src", "t"], "left_semi")
    far = influence_features(of, shares, hmax).select(*key, (F.col("place") + at + 4).alias("place"), "value")
    return lags.union(sign).union(now).union(far).where("value <> 0")


def feature_width(kmax: int, hmax: int, lookback: int = 5) -> int:
    return lookback + kmax + 4 + len(BLOCKS) * (hmax + 1) + 1


def feature_rows(samples: DataFrame, *of, width: int, **how) -> DataFrame:
    """`samples` with `features`, an array of feature_values; what has no value is 0."""
    values = feature_values(samples, *of, **how).groupBy("node", "time").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return samples.join(values, ["node", "time"], "left").select(*samples.columns, F.transform(places, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("features"))


@dataclass(frozen=True)
class Defaults:
    """Of training: rounds, how many without gain end it, step, decay of weights, and strength of positive weights."""

    epochs: int = 60
    patience: int = 8
    step: float = 0.05
    decay: float = 1e-4
    power: float = 0.5


@dataclass
class Predictor:
    """Ordinal model of the coreness at the next snapshot: the log odds of reaching k are those of staying, plus a learnt
    linear part in scaled features. Untrained, the linear part is 0 and the prediction is today's coreness."""

    kmax: int
    lookback: int
    mean: list[float]
    scale: list[float]
    weights: list[list[float]]  # kmax x features
    bias: list[float]
    made_of: dict = field(default_factory=dict)

    @classmethod
    def untrained(cls, kmax: int, width: int, lookback: int = 5) -> Predictor:
        return cls(kmax, lookback, [0.0] * width, [1.0] * width, [[0.0] * width for _ in range(kmax)], [0.0] * kmax)

    def logits(self, features: np.ndarray) -> np.ndarray:
        """rows x kmax."""
        j = np.arange(self.kmax + 1)
        stay = -2.0 * np.abs(j - np.clip(features[:, :1], 0, self.kmax))
        part = np.exp(stay - stay.max(axis=1, keepdims=True))
        over = np.cumsum(part[:, ::-1], axis=1)[:, ::-1][:, 1:]
        prior = np.log(over) - np.log(part.sum(axis=1, keepdims=True) - over)
        return prior + (features - self.mean) / self.scale @ np.array(self.weights).T + self.bias

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with `pred`, the number of thresholds the log odds of which are over 0; by columns alone, batch by batch inside the JVM."""
        stay = ordinal.cumulative_logits(ordinal.persistence_logits(F.least(F.greatest(F.element_at("features", 1), F.lit(0.0)), F.lit(float(self.kmax))), self.kmax), self.kmax)
        inverse = [[w / s for w, s in zip(ws, self.scale, strict=True)] for ws in self.weights]
        bias = [b - sum(w * m for w, m in zip(ws, self.mean, strict=True)) for b, ws in zip(self.bias, inverse, strict=True)]
        dot = [F.aggregate(F.zip_with("features", F.array(*map(F.lit, ws)), lambda x, y: x * y), F.lit(b), lambda a, x: a + x) for ws, b in zip(inverse, bias, strict=True)]
        return rows.withColumn("pred", ordinal.decode(F.zip_with(stay, F.array(*dot), lambda x, y: x + y)))

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, json.dumps(self.__dict__, sort_keys=True), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, kmax: int | None = None, width: int | None = None, **made_of) -> Predictor:
        """A saved model; one that doesn't fit the data (greatest coreness, width, or any of `made_of`) is refused."""
        m = cls(**json.loads(read_text(spark, path)))
        if len(m.weights) != m.kmax or any(len(w) != len(m.mean) for w in m.weights) or len(m.bias) != m.kmax or len(m.scale) != len(m.mean):
            raise ValueError("the saved model is damaged")
        for name, want, has in (("kmax", kmax, m.kmax), ("width", width, len(m.mean)), *((k, v, m.made_of.get(k)) for k, v in made_of.items())):
            if want is not None and want != has:
                raise ValueError(f"the saved model has {name} {has}, not {want}")
        return m


def _sums(batches, model: Predictor, pos: np.ndarray, learn: bool):
    """Of rows (features, label): their number, loss, wrong predictions and, to learn, the gradient."""
    n, loss, wrong, gw, gb = 0, 0.0, 0, np.zeros((model.kmax, len(model.mean))), np.zeros(model.kmax)
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        y = (b.column(1).to_numpy(zero_copy_only=False)[:, None] >= np.arange(1, model.kmax + 1)).astype(float)
        z = model.logits(x)
        soft = np.logaddexp(0, -z)  # -log sigmoid(z)
        n, loss, wrong = n + len(x), loss + float((pos * y * soft + (1 - y) * (soft + z)).sum()), wrong + int(((z > 0).sum(axis=1) != y.sum(axis=1)).sum())
        if learn:
            p = 1 / (1 + np.exp(-z))
            d = p * (1 - y) - pos * y * (1 - p)
            gw += d.T @ ((x - model.mean) / model.scale)
            gb += d.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([wrong]), pa.array([np.concatenate([gw.ravel(), gb]).tolist()], pa.list_(pa.float64()))], ["n", "loss", "wrong", "gradient"])


def evaluate(model: Predictor, rows: DataFrame, pos: np.ndarray, learn: bool = False) -> tuple[int, float, float, np.ndarray]:
    """(rows, mean loss, share of right predictions, mean gradient) over rows (features, label); each partition sends its sums alone."""
    got = rows.select("features", "label").mapInArrow(lambda b: _sums(b, model, pos, learn), "n long, loss double, wrong long, gradient array<double>").collect()
    n = sum(r.n for r in got) or 1
    return n, sum(r.loss for r in got) / n, 1 - sum(r.wrong for r in got) / n, np.sum([r.gradient for r in got], axis=0) / n


def fit_predictor(rows: DataFrame, kmax: int, defaults: Defaults = Defaults(), lookback: int = 5, **made_of) -> Predictor:
    """Trains on rows (split, features, label): weighted logistic loss over the thresholds, Adam on whole rounds, and of all
    rounds the one with the least loss on the validation rows; `patience` rounds without a gain end it."""
    rows = kept(rows.select("split", "features", "label"))
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    width = len(train.first()["features"])
    place = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row for each feature
    weight = {r.k: r.weight for r in ordinal.positive_weights(train, "label", kmax, defaults.power).collect()}
    pos = np.array([weight[k] for k in range(1, kmax + 1)])
    model = Predictor.untrained(kmax, width, lookback)
    model.mean, model.scale, model.made_of = [r.m for r in place], [r.s if r.s > 1e-9 else 1.0 for r in place], made_of
    best, least, since = model, evaluate(model, val, pos)[1], 0
    theta, m, v = np.zeros(kmax * (width + 1)), 0.0, 0.0
    for epoch in range(1, defaults.epochs + 1):
        g = evaluate(model, train, pos, learn=True)[3] + defaults.decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - defaults.step * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        model = Predictor(kmax, lookback, model.mean, model.scale, theta[: kmax * width].reshape(kmax, width).tolist(), theta[kmax * width :].tolist(), made_of)
        loss = evaluate(model, val, pos)[1]
        if loss < least - 1e-9:
            best, least, since = model, loss, 0
        elif (since := since + 1) >= defaults.patience:
            break
    return best


def pending(samples: DataFrame, done: DataFrame, key: tuple[str, ...] = ("query", "k", "t")) -> DataFrame:
    """Samples of a resumed evaluation that have no result yet."""
    return samples.join(done.select(*key), list(key), "left_anti")


def progress(samples: DataFrame, done: DataFrame, metric: str) -> DataFrame:
    """(k, total, completed, value): the mean of a metric over each k, infinite until all its samples are done."""
    key = ["query", "k", "t"]
    rows = samples.join(done.select(*key, F.col(metric).alias("m"), F.lit(True).alias("hit")), key, "left").groupBy("k")
    n = rows.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("completed"), F.avg("m").alias("mean"))
    return n.select("k", "total", "completed", F.when(F.col("total") == F.col("completed"), F.col("mean")).otherwise(F.lit(float("inf"))).alias("value"))
