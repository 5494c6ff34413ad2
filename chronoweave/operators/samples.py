"""Time splits, prediction samples, cohorts and sampling. Chance comes from md5 of a row's key, so results don't depend on partitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.edge_log import dense_ids
from ..tables import kept
from .snapshots import first_seen

KS = (3, 4, 5, 6, 7)
#: Fixed by the datasets' protocol: the only dataset of which a share of the cohort is drawn.
SAMPLE_FRACTIONS = {"wiki-talk-temporal": Fraction(1, 6)}


def evaluation_start(n: int) -> int:
    start = int(n * 0.85)
    if not int(n * 0.7) <= start < n - 1:
        raise ValueError("too few snapshots")
    return start


def split_bounds(n: int, train: float = 0.7, val: float = 0.15) -> tuple[int, int]:
    """Query times: train [0, a), val [a, b), test [b, n - 1)."""
    if n < 4 or not 0 < train < 1 or not 0 < val < 1 or train + val >= 1:
        raise ValueError("no such split")
    a = int(n * train) - 1
    if (train, val) == (0.55, 0.15):
        b = int(n * 0.7)
    elif (train, val) == (0.7, 0.15):
        b = evaluation_start(n)
    else:
        b = int(n * (train + val))
    if not 1 <= a < b < n - 1:
        raise ValueError("a part of the split is empty")
    return a, b


def split_rule(train: float, val: float) -> str:
    return {(0.7, 0.15): "snapshot_70_15_15_current_query_v1", (0.55, 0.15): "snapshot_55_15_30_v1"}.get((train, val), "custom_snapshot_split_v1")


def split_of(t: Column, a: int, b: int) -> Column:
    return F.when(t < a, "train").when(t < b, "val").otherwise("test")


def unit(*key: Column | str) -> Column:
    """A number in (0, 1) from md5 of the key's parts, joined by colons."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("long")
    return (h + 1) / F.lit(float(2**52 + 1))


def coreness_samples(cores: DataFrame, n: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(split, node, time, label): each node seen up to t and its coreness at t + 1, 0 if it isn't there."""
    a, b = split_bounds(n, train, val)
    seen = first_seen(cores)
    rows = seen.where(F.col("first_t") <= n - 2).withColumn("time", F.explode(F.sequence("first_t", F.lit(n - 2)))).select("node", "time")
    after = cores.select("node", (F.col("t") - 1).alias("time"), "core")
    return rows.join(after, ["node", "time"], "left").select(split_of(F.col("time"), a, b).alias("split"), "node", "time", F.coalesce("core", F.lit(0)).alias("label"))


def inference_samples(cores: DataFrame, t: int) -> DataFrame:
    return first_seen(cores).where(F.col("first_t") <= t).select("node", F.lit(t).cast("int").alias("time"))


def core_history(samples: DataFrame, cores: DataFrame, lookback: int = 5) -> DataFrame:
    """(node, time, lag, core): coreness at time - lag for lag = 0..lookback - 1, 0 where the node isn't there."""
    rows = samples.select("node", "time").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lookback - 1)))).withColumn("t", F.col("time") - F.col("lag"))
    return rows.join(cores.select("node", "t", "core"), ["node", "t"], "left").select("node", "time", "lag", F.coalesce("core", F.lit(0)).alias("core"))


def round_robin(nodes: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """`limit` nodes of each t, by turns from each coreness, the highest first."""
    turn = F.row_number().over(Window.partitionBy("t", "core").orderBy(unit(F.lit(seed), "t", "node"), "node"))
    pick = F.row_number().over(Window.partitionBy("t").orderBy("turn", F.col("core").desc()))
    return nodes.withColumn("turn", turn).withColumn("pick", pick).where(F.col("pick") <= limit).select("t", "node", "core")


def weighted_order(weight: Column, *key: Column | str) -> Column:
    """Rows in this order, cut anywhere, are a draw without replacement by weight."""
    return -F.ln(unit(*key)) / weight


def stays(kcore: DataFrame, cores: DataFrame) -> DataFrame:
    """(t, k, node, core, stays) of k-core nodes that have a next snapshot; stays if coreness at t + 1 is at least k."""
    now = kcore.select("t", "k", "node").join(cores, ["t", "node"])
    after = cores.select((F.col("t") - 1).alias("t"), "node", F.col("core").alias("next"))
    return now.join(after, ["t", "node"], "left").select("t", "k", "node", "core", (F.coalesce("next", F.lit(0)) >= F.col("k")).alias("stays"))


def cohort(kcore: DataFrame, cores: DataFrame, n: int, start: int, most: int = 20, most_empty: int = 5, seed: int = 42) -> DataFrame:
    """(query, k, t, empty): of each (t, k) up to `most` nodes that stay, by weight, and where there are any, a quarter as many that leave (at least one, at most `most_empty`)."""
    rows = stays(kcore, cores).where((F.col("t") >= start) & (F.col("t") < n - 1))
    weight = F.greatest(F.lit(1), F.col("core") - F.col("k") + 1)
    order = weighted_order(weight, F.lit(seed), "t", "k", "node")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("t", "k", "stays").orderBy(order, "node")))
    of = Window.partitionBy("t", "k")
    kept = F.least(F.lit(most), F.count_if("stays").over(of))
    quota = F.when(F.col("stays"), F.lit(most)).when(F.col("kept") > 0, F.least(F.lit(most_empty), F.greatest(F.lit(1), F.floor(F.col("kept") / 4)))).otherwise(0)
    rows = rows.withColumn("kept", kept).where(F.col("r") <= quota)
    return rows.select(F.col("node").alias("query"), "k", "t", (~F.col("stays")).alias("empty"))


def truths(queries: DataFrame, kcore: DataFrame) -> DataFrame:
    """`queries` with `community`: the members of the query's component in the k-core of t + 1, sorted; empty if it isn't in one."""
    own = kcore.select((F.col("t") - 1).alias("t"), "k", F.col("node").alias("query"), "component_id")
    parts = kcore.groupBy((F.col("t") - 1).alias("t"), "k", "component_id").agg(F.sort_array(F.collect_list("node")).alias("community"))
    found = queries.join(own, ["t", "k", "query"], "left").join(parts, ["t", "k", "component_id"], "left").drop("component_id")
    return found.withColumn("community", F.coalesce("community", F.array().cast("array<bigint>")))


def truth_members(queries: DataFrame, kcore: DataFrame) -> DataFrame:
    """(query, k, t, node): the same truths, a row for each member."""
    own = kcore.select((F.col("t") - 1).alias("t"), "k", F.col("node").alias("query"), "component_id")
    parts = kcore.select((F.col("t") - 1).alias("t"), "k", "component_id", "node")
    return queries.select("query", "k", "t").join(own, ["t", "k", "query"]).join(parts, ["t", "k", "component_id"]).select("query", "k", "t", "node")


def sampled(queries: DataFrame, dataset: str, fractions: dict[str, Fraction] | None = None) -> DataFrame:
    """The share of a cohort that is drawn for a dataset; whole for most."""
    share = (SAMPLE_FRACTIONS if fractions is None else fractions).get(dataset, Fraction(1))
    return queries if share == 1 else stratified_downsample(queries, float(share))


def cohort_name(dataset: str, fractions: dict[str, Fraction] | None = None) -> str:
    """The name under which a dataset's cohort is kept: its share is told by a suffix."""
    return dataset + fraction_suffix((SAMPLE_FRACTIONS if fractions is None else fractions).get(dataset, Fraction(1)))


def stratified_downsample(queries: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A share of (query, k, t, empty), by largest remainders over (t, k, empty); the whole count is rounded half to even, one at least."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction is over 0 and at most 1")
    n = queries.count()
    target = max(1, round(n * fraction)) if n else 0
    by = ["t", "k", "empty"]
    sizes = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))  # one row for each stratum
    exact = F.col("size") * F.lit(float(fraction))
    sizes = sizes.withColumn("base", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    tie = unit(F.lit(seed), "t", "k", F.col("empty").cast("int"))
    order = F.row_number().over(Window.orderBy(F.round("rest", 9).desc(), tie))
    sizes = sizes.withColumn("r", order).withColumn("left", F.lit(target) - F.sum("base").over(Window.partitionBy()))
    quota = sizes.select(*by, (F.col("base") + (F.col("r") <= F.col("left")).cast("int")).alias("quota"))
    pick = F.row_number().over(Window.partitionBy(*by).orderBy(unit(F.lit(seed), "t", "k", "query"), "query"))
    return queries.withColumn("pick", pick).join(quota, by).where("pick <= quota").drop("pick", "quota")


def fraction_suffix(fraction: Fraction) -> str:
    f = Fraction(fraction).limit_denominator()
    return "" if f == 1 else f"_f{f.numerator}of{f.denominator}"


def check_cohort(queries: DataFrame, n: int, start: int) -> DataFrame:
    """(query, k, t, fault) of rows that no cohort may have."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("query", "k", "t"))
    fault = F.when((F.col("t") < start) | (F.col("t") >= n - 1), "time").when(~F.col("k").isin(*KS), "k").when(copies > 1, "repeated")
    fault = fault.when((F.size("community") > 0) & ~F.array_contains("community", F.col("query")), "query not in truth")
    return queries.withColumn("fault", fault).where("fault is not null").select("query", "k", "t", "fault")


def negative_edges(edges: DataFrame, nodes: DataFrame, seed: int = 42, rounds: int = 40) -> DataFrame:
    """(t, u, v): for each edge of t + 1 a pair of nodes seen up to t that isn't one of its edges, drawn evenly with
    replacement by hash; a pair that is an edge or a loop is drawn again. None is left out: where a snapshot has no such
    pair, or `rounds` draws don't find one, it is an error.

    Nodes are numbered by when they were first seen, so that those seen up to t are the first ones: a draw is a number
    under their count, and no list of nodes is made for each time.
    """
    order = dense_ids(first_seen(nodes).withColumn("at", F.struct("first_t", "node")), "at", "i").select("node", "first_t", "i")
    times = edges.select((F.col("t") - 1).alias("t"), "u", "v").where("t >= 0")
    new = order.groupBy("first_t").agg(F.count(F.lit(1)).alias("new"))  # one row for each snapshot with new nodes, as `at`
    at = times.select("t").distinct()
    count = at.join(new, F.col("first_t") <= F.col("t")).groupBy("t").agg(F.sum("new").alias("n"))
    known = times.join(order.select(F.col("node").alias("u"), F.col("first_t").alias("fu")), "u").join(order.select(F.col("node").alias("v"), F.col("first_t").alias("fv")), "v")
    pairs = known.where("fu <= t and fv <= t").groupBy("t").agg(F.count(F.lit(1)).alias("taken"))
    full = at.join(count, "t", "left").join(pairs, "t", "left").where("coalesce(n, 0) * (coalesce(n, 0) - 1) / 2 <= coalesce(taken, 0)")
    if not full.isEmpty():
        raise ValueError("a snapshot has no pair of known nodes that isn't its edge")
    hit = times.select("t", F.col("u").alias("p"), F.col("v").alias("q"))
    left, out = kept(times.join(count, "t").select("t", "n", F.concat_ws(":", "t", "u", "v").alias("key"))), None
    for r in range(rounds):
        draw = (F.floor(unit(F.lit(f"{seed}:{r}:{side}"), "key") * F.col("n")).cast("long").alias(f"i{side}") for side in "ab")
        drawn = left.select("t", "n", "key", *draw)
        for x, i in (("x", "ia"), ("y", "ib")):
            drawn = drawn.join(order.select(F.col("i").alias(i), F.col("node").alias(x)), i)
        drawn = drawn.select("t", "n", "key", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
        drawn = kept(drawn.join(hit.withColumn("hit", F.lit(True)), ["t", "p", "q"], "left").withColumn("good", F.col("hit").isNull() & (F.col("p") != F.col("q"))))
        part = drawn.where("good").select("t", F.col("p").alias("u"), F.col("q").alias("v"))
        out = part if out is None else out.union(part)
        left = drawn.where("not good").select("t", "n", "key")
        if left.isEmpty():
            return out
    raise ValueError("a snapshot is too dense for so many draws")


def labelled_pairs(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(split, t, u, v, label): the edges of t + 1 between nodes seen up to t, and as many pairs that aren't, for a link scorer that knows snapshots up to t."""
    a, b = split_bounds(n)
    seen = first_seen(nodes)
    rows = edges.select((F.col("t") - 1).alias("t"), "u", "v").where("t >= 0")
    for side in "uv":
        rows = rows.join(seen.select(F.col("node").alias(side), F.col("first_t").alias(f"f{side}")), side).where(F.col(f"f{side}") <= F.col("t"))
    both = rows.select("t", "u", "v", F.lit(1).alias("label")).union(negative_edges(edges, nodes, seed).select("t", "u", "v", F.lit(0)))
    return both.select(split_of(F.col("t"), a, b).alias("split"), "t", "u", "v", "label")
