"""h-index levels and the distributions of a node's neighbourhood over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cores import h_indexes
from .snapshots import adjacency

BLOCKS = ("h1", "h2", "h3", "core")


def node_state(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """(t, node, degree, h1, h2, h3, core): each h-index level is the h-index of the neighbours' level below, the degree being level 0."""
    adj = adjacency(edges)
    state = adj.groupBy("t", "a").agg(F.count(F.lit(1)).cast("int").alias("degree")).withColumnRenamed("a", "node")
    below = "degree"
    for level in BLOCKS[:3]:
        near = state.select("t", F.col("node").alias("b"), F.col(below).alias("x"))
        new = h_indexes(adj.join(near, ["t", "b"]), ["t", "a"], "x", level)
        state = state.join(new.withColumnRenamed("a", "node"), ["t", "node"])
        below = level
    out = cores.join(state, ["t", "node"], "left")
    return out.select("t", "node", *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("degree", *BLOCKS)))


def structure(edges: DataFrame, state: DataFrame, cmax: int) -> DataFrame:
    """(t, node, block, bucket, share) with share > 0: how the closed neighbourhood's values spread over buckets 0..cmax, the last for all from cmax on."""
    near = adjacency(edges).union(state.select("t", "node", "node"))
    blocks = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.least(F.col(b), F.lit(cmax)).alias("bucket")) for b in BLOCKS)))
    values = state.select("t", F.col("node").alias("b"), blocks.alias("x")).select("t", "b", "x.block", "x.bucket")
    size = near.groupBy("t", "a").agg(F.count(F.lit(1)).alias("size"))
    n = near.join(values, ["t", "b"]).groupBy("t", "a", "block", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return n.join(size, ["t", "a"]).select("t", F.col("a").alias("node"), "block", "bucket", (F.col("n") / F.col("size")).alias("share"))


def structure_vectors(shares: DataFrame, cmax: int) -> DataFrame:
    """(t, node, dist): the blocks' buckets one after another."""
    place = F.array_position(F.array(*map(F.lit, BLOCKS)), F.col("block")) - 1
    at = (place * (cmax + 1) + F.col("bucket")).cast("int")
    maps = shares.groupBy("t", "node").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("share").cast("float").alias("v")))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(len(BLOCKS) * (cmax + 1) - 1))
    return maps.select("t", "node", F.transform(places, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0).cast("float"))).alias("dist"))


def absent_vector(cmax: int) -> list[float]:
    """Of a node that isn't in a snapshot: all of every block in bucket 0."""
    return [float(i % (cmax + 1) == 0) for i in range(len(BLOCKS) * (cmax + 1))]
