"""Streams of snapshots: state that only moves forward, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import history
from ..operators.influence import NORMS, STATE, advance

CORES = "t int, node long, core int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, root: str, at_most: int | None = None) -> int | None:
    """The greatest t with saved state, not after `at_most`. A folder counts once its writer has committed it."""
    if not exists(spark, root):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    times = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("t=") and exists(spark, f"{root}/{s.getPath().getName()}/_SUCCESS")]
    return max((t for t in times if at_most is None or t <= at_most), default=None)


def follow_signatures(source: DataFrame, root: str, kmax: int, checkpoint: str):
    """Advance core signatures with each micro-batch of (t, node, core); states are kept under root/state/t=N, rows that
    come too late under root/late. A batch that runs again after a failure finds its states there and writes nothing twice."""
    spark = source.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        done = latest(spark, f"{root}/state")
        late = df.where(F.col("t") <= (done if done is not None else -1))
        late.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")
        times = sorted(r.t for r in df.select("t").distinct().collect() if done is None or r.t > done)
        for t in times:
            state = spark.read.parquet(f"{root}/state/t={done}") if done is not None else spark.createDataFrame([], "node long, last_t int, sums array<double>")
            history.advance(state, df.where(F.col("t") == t), t, kmax).write.mode("overwrite").parquet(f"{root}/state/t={t}")
            done = t
        df.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def follow_influence(source: DataFrame, root: str, checkpoint: str):
    """The same for temporal PageRank on edges (t, u, v); its update reads neighbours' states, so it isn't a state by key."""
    spark = source.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        done = latest(spark, f"{root}/norms")
        for t in sorted(r.t for r in df.select("t").distinct().collect() if done is None or r.t > done):
            old = [spark.read.parquet(f"{root}/{n}/t={done}") if done is not None else spark.createDataFrame([], s) for n, s in (("state", STATE), ("norms", NORMS))]
            state, norms = advance(*old, df.where(F.col("t") == t), t)
            state.write.mode("overwrite").parquet(f"{root}/state/t={t}")
            norms.write.mode("overwrite").parquet(f"{root}/norms/t={t}")
            done = t
        df.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def drop_old_states(spark: SparkSession, root: str, keep: int) -> None:
    """Bounded retention: all but the last `keep` states go."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((int(s.getPath().getName()[2:]), s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("t="))
    for _, path in found[:-keep] if keep else found:
        fs.delete(path, True)


def signatures_by_key(source: DataFrame, kmax: int, alpha: float = history.ALPHA) -> DataFrame:
    """(node, t, vec) updates of a stream (t, node, core): a node's signature depends on its own past alone, so its state is keyed by node. Rows before a node's last time are left out."""
    out, state = "node long, t int, vec array<double>", "last_t int, sums array<double>"

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, sums = held.get if held.exists else (-1, [0.0] * kmax)
        sums, rows = list(sums), []
        for r in pd.concat(frames).sort_values("t").itertuples():
            if r.t <= last:
                continue
            decay = alpha ** (r.t - last) if last >= 0 else 1.0
            sums = [s * decay + (r.core / k if r.core <= k else 2 - k / r.core) for k, s in enumerate(sums, 1)]
            last = int(r.t)
            total = (1 - alpha ** (last + 1)) / (1 - alpha)
            rows.append((key[0], last, [s / total for s in sums]))
        held.update((last, sums))
        yield pd.DataFrame(rows, columns=["node", "t", "vec"])

    return source.groupBy("node").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def window_counts(source: DataFrame, s0: int, step: int, window: int, lateness: str = "0 seconds") -> DataFrame:
    """(start_ts, end_ts, edge_count) of a stream (u, v, ts), for step <= window; a window is given out once the watermark passes its end."""
    if step > window:
        raise ValueError("windows with gaps are assigned by arithmetic, in batches")
    rows = source.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness)
    span = F.window("at", f"{window} seconds", f"{step} seconds", f"{s0 % step} seconds")
    n = rows.groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("edge_count"))
    return n.select(F.unix_seconds("w.start").alias("start_ts"), F.unix_seconds("w.end").alias("end_ts"), "edge_count")
