"""Registered graph queries: each a function of (spark, sf_dir), with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ordinal, ranking, sets
from ..operators import communities, cores, edge_generation, features, history, influence, samples, snapshots, structure
from ..sources import edge_log
from ..tables import kept
from .base import Graph, graph
from .sql import MD5_UNIT, influence_parts, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Snapshots of the events table at every scale: a month of days.
SNAPSHOTS = 30
STATE = influence_parts(SNAPSHOTS)


def query(name: str, final: str | None = None, *needs: str):
    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(graph(spark, sf_dir))
        if final:
            SQL[name] = sql(final, *needs)
        return f

    return add


def r6(c) -> Column:
    """Six digits, and never a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# ---- sources, standardisation, export -------------------------------------------------------------


@query("src_event_edges", "SELECT u, v, ts FROM e", "e")
def _(g):
    return g.log.select("u", "v", "ts")


@query("src_window_scan", "SELECT u, v, ts FROM m0 WHERE window_index = 5", "m0")
def _(g):
    s0, n, _, _ = snapshots.window_plan(g.log)
    start = s0 + 5 * snapshots.STEP
    return g.log.where((F.col("ts") >= start) & (F.col("ts") < start + snapshots.WINDOW)).select("u", "v", "ts")


@query("src_bounds", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS records FROM e", "e")
def _(g):
    return g.log.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("records"))


RAW_SQL = "(SELECT event_id AS ord, user_id AS u, (event_id * 7) % 150 AS v, CAST(epoch(ts) * 1000000 AS BIGINT) AS us FROM events)"


def _raw(g: Graph) -> DataFrame:
    """The events as raw records with fractional times, a partner made from the event's number."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = g.table("events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("u"), (F.col("event_id") * 7 % 150).alias("v"), micros.alias("us"))
    return rows.withColumn("ts", F.col("us").cast("decimal(38,9)") / F.lit(1_000_000).cast("decimal(10,0)"))


@query("src_standardise", f"SELECT u, v, ts, ord FROM (SELECT *, row_number() OVER (PARTITION BY ts, least(u, v), greatest(u, v) ORDER BY ord) AS r FROM (SELECT u, v, ord, CAST(floor(us / 1000000) AS BIGINT) AS ts FROM {RAW_SQL}) WHERE u <> v AND ts >= 1704100000) WHERE r = 1")
def _(g):
    return edge_log.standardise(_raw(g), 1_704_100_000)


@query(
    "src_standardise_audit",
    f"""WITH r AS (SELECT *, CAST(floor(us / 1000000) AS BIGINT) AS ts, us % 1000000 <> 0 AS fr FROM {RAW_SQL}),
l AS (SELECT *, lag(ts) OVER (ORDER BY ord) AS before FROM r),
k AS (SELECT count(DISTINCT (ts, least(u, v), greatest(u, v))) AS written FROM r WHERE u <> v AND ts >= 1704100000)
SELECT count(*) AS records, count(*) FILTER (u = v) AS loops, count(*) FILTER (u <> v AND ts < 1704100000) AS before_start, count(*) FILTER (fr) AS fractional, count(*) FILTER (before > ts) AS descents,
any_value(written) AS written, count(*) - count(*) FILTER (u = v) - count(*) FILTER (u <> v AND ts < 1704100000) - any_value(written) AS duplicates FROM l, k""",
)
def _(g):
    return edge_log.standardise_audit(_raw(g), 1_704_100_000)


@query("src_txt", "SELECT c_custkey AS ord, c_custkey AS u, c_nationkey AS v, c_custkey AS ts FROM customer WHERE c_custkey % 7 <> 0")
def _(g):
    lines = g.table("customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("  # row "), "c_custkey")).otherwise(F.concat_ws("  \t", "c_custkey", "c_nationkey", "c_custkey")).alias("value"))
    return edge_log.parse_text(lines).withColumn("ts", F.col("ts").cast("long"))


COIN_SQL = "(SELECT event_id AS ord, event_type AS src, concat('acct-', user_id) AS dst, CAST(epoch(CAST(ts AS DATE)) / 86400 AS BIGINT) AS day FROM events)"


def _coin(g: Graph) -> DataFrame:
    return g.table("events").select(F.col("event_id").alias("ord"), F.unix_date(F.to_date("ts")).cast("long").alias("day"), F.col("event_type").alias("src"), F.concat(F.lit("acct-"), "user_id").alias("dst"))


COIN_IDS = f"d AS (SELECT address, row_number() OVER (ORDER BY min(o)) - 1 AS id FROM (SELECT src AS address, ord * 2 AS o FROM {COIN_SQL} UNION ALL SELECT dst, ord * 2 + 1 FROM {COIN_SQL}) GROUP BY 1)"


@query("src_coin", f"WITH {COIN_IDS} SELECT ord, a.id AS u, b.id AS v, day AS ts FROM {COIN_SQL} JOIN d a ON a.address = src JOIN d b ON b.address = dst")
def _(g):
    return edge_log.coin_edges(_coin(g))[0].withColumn("ts", F.col("ts").cast("long"))


@query("src_coin_nodes", f"WITH {COIN_IDS} SELECT id AS node_id, address FROM d")
def _(g):
    return edge_log.coin_edges(_coin(g))[1]


@query("src_supply_edges", "SELECT l_suppkey AS u, 1000000000 + l_partkey AS v, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts FROM lineitem")
def _(g):
    return edge_log.supply_edges(g.spark, g.dir).select("u", "v", "ts")


@query("src_descents", "SELECT count(*) AS n FROM (SELECT ts, lag(ts) OVER (ORDER BY ord) AS before FROM e) WHERE before > ts", "e")
def _(g):
    return edge_log.descents(g.log).agg(F.count(F.lit(1)).alias("n"))


@query("sink_export_events", "SELECT DISTINCT u, v, CAST(t + 1 AS BIGINT) AS ts FROM s", "s")
def _(g):
    return edge_log.export_events(g.edges)


@query("sink_export_splits", "SELECT CASE WHEN t < a THEN 'train' WHEN t < b THEN 'val' ELSE 'test' END AS split, count(*) AS events FROM s, bounds GROUP BY 1", "s bounds")
def _(g):
    a, b = samples.split_bounds(g.n)
    return g.edges.groupBy(samples.split_of(F.col("t"), a, b).alias("split")).agg(F.count(F.lit(1)).alias("events"))


@query("src_mapping_gaps", "SELECT DISTINCT node AS original_id FROM nd WHERE node % 3 = 0", "nd")
def _(g):
    ids = g.nodes.select("node").distinct()
    mapping = ids.where("node % 3 <> 0").select(F.col("node").alias("original_id"), F.col("node").alias("dense_id"))
    times = g.windows.select((F.col("t") + 1).alias("step"), F.col("window_index").alias("slice_index"))
    return edge_log.check_mappings(g.nodes, mapping, times)[0]


@query("src_factorise", "SELECT node, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM (SELECT u AS node, ord AS p FROM e UNION ALL SELECT v, ord + (SELECT max(ord) + 1 FROM e) FROM e) GROUP BY 1", "e")
def _(g):
    ends = g.log.select(F.posexplode(F.array("u", "v")).alias("side", "node"), "ord")
    first = ends.groupBy("node").agg(F.min(F.struct("side", "ord")).alias("at"))
    return edge_log.dense_ids(first, "at", "id").select("node", "id")


# ---- windows and snapshots ------------------------------------------------------------------------


@query("windows", "SELECT t, window_index, start_ts, end_ts, edge_count FROM wt", "wt")
def _(g):
    return g.windows


@query("windows_gapped", "SELECT i AS window_index, count(*) AS edge_count FROM (SELECT max(ts) + 1 - 3600 - CAST(floor((max(ts) - min(ts)) / 7200) AS BIGINT) * 7200 AS s0, CAST(floor((max(ts) - min(ts)) / 7200) AS BIGINT) + 1 AS n FROM e) p, range(100000) AS x(i), e WHERE i < n AND ts >= s0 + i * 7200 AND ts < s0 + i * 7200 + 3600 GROUP BY 1", "e")
def _(g):
    return snapshots.windows(g.log, 7200, 3600).select("window_index", "edge_count")


@query("window_hashes", "SELECT window_index, sha256(string_agg(concat(u, ',', v, ',', ts, chr(10)), '' ORDER BY ts, ord)) AS sha256 FROM m0 GROUP BY 1", "m0")
def _(g):
    return snapshots.window_hashes(g.log)


@query("window_memberships", "SELECT sum(edge_count)::BIGINT AS memberships FROM wt", "wt")
def _(g):
    return g.windows.agg(F.sum("edge_count").alias("memberships"))


@query("snapshot_edges", "SELECT t, u, v FROM s", "s")
def _(g):
    return g.edges


@query("snapshot_nodes", "SELECT t, node FROM nd", "nd")
def _(g):
    return g.nodes


@query("total_nodes", "SELECT count(DISTINCT node) AS total_nodes FROM nd", "nd")
def _(g):
    return g.nodes.agg(F.countDistinct("node").alias("total_nodes"))


@query("snapshot_adjacency", "SELECT t, a AS node, CAST(array_to_string(list(b ORDER BY b), ',') AS VARCHAR) AS neighbours FROM adj GROUP BY 1, 2", "adj")
def _(g):
    return communities.neighbours(g.edges).select("t", F.col("a").alias("node"), F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours"))


@query("cumulative_adjacency", "SELECT x.t, x.node, count(b) AS neighbours, CAST(coalesce(sum(b), 0) AS BIGINT) AS id_sum FROM (SELECT node, CAST(unnest(range(first_t, n)) AS INTEGER) AS t FROM fs, nt) x LEFT JOIN (SELECT u AS a, v AS b, first_t FROM hist UNION ALL SELECT v, u, first_t FROM hist) y ON x.node = a AND first_t <= x.t GROUP BY 1, 2", "fs nt hist")
def _(g):
    rows = snapshots.cumulative_adjacency(g.edges, g.nodes, g.n - 1)
    return rows.select("t", "node", F.size("neighbours").cast("long").alias("neighbours"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("edge_history", "SELECT u, v, first_t FROM hist", "hist")
def _(g):
    return snapshots.edge_history(g.edges)


@query("new_edges", "SELECT s.t, count(*) AS new_edges FROM s JOIN hist h ON h.u = s.u AND h.v = s.v AND first_t = s.t GROUP BY 1", "s hist")
def _(g):
    return snapshots.edge_history(g.edges).groupBy(F.col("first_t").alias("t")).agg(F.count(F.lit(1)).alias("new_edges"))


@query("first_seen", "SELECT node, first_t FROM fs", "fs")
def _(g):
    return snapshots.first_seen(g.nodes)


@query("degree", "SELECT t, node, x AS degree FROM deg", "deg")
def _(g):
    return snapshots.adjacency(g.edges).groupBy("t", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


# ---- cores and structure --------------------------------------------------------------------------


@query("coreness", "SELECT t, node, core FROM core", "core")
def _(g):
    return g.core


@query("coreness_by_joins", "SELECT t, node, x::INTEGER AS core FROM rec WHERE it = 80", "rec")
def _(g):
    return cores.coreness_by_joins(g.edges)


@query("edge_min_core", "SELECT t, u, v, min_core FROM mc", "mc")
def _(g):
    return g.min_core


@query("kcore_members", "SELECT t, k, component_id, node FROM kc", "kc")
def _(g):
    return g.kcore


@query("kcore_components", "SELECT t, k, component_id, count(*) AS size FROM kc GROUP BY 1, 2, 3", "kc")
def _(g):
    return g.kcore.groupBy("t", "k", "component_id").agg(F.count(F.lit(1)).alias("size"))


@query("node_state", "SELECT t, node, degree, h1, h2, h3, core FROM ns", "ns")
def _(g):
    return g.state


@query("maxima", "SELECT kmax, hmax FROM mx", "mx")
def _(g):
    return g.state.agg(F.max("core").alias("kmax"), F.max("h1").alias("hmax"))


@query("structure", "SELECT t, node, block, bucket, round(share, 6) AS share FROM sh", "sh")
def _(g):
    return g.shares.withColumn("share", r6("share"))


@query("structure_vectors", "SELECT t, node, round(sum(share), 6) AS total, 4 * (any_value(hmax) + 1) AS places FROM sh, mx GROUP BY 1, 2", "sh mx")
def _(g):
    v = structure.structure_vectors(g.shares, g.hmax)
    return v.select("t", "node", r6(F.aggregate("dist", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("dist").alias("places"))


@query("induced_edges", "SELECT a.k, s.t, s.u, s.v FROM s JOIN kc a ON a.t = s.t AND a.node = s.u JOIN kc b ON b.t = s.t AND b.k = a.k AND b.node = s.v", "s kc")
def _(g):
    inside = g.kcore.select("t", "k", "node")
    one = g.edges.join(inside.withColumnRenamed("node", "u"), ["t", "u"])
    return one.join(inside.withColumnRenamed("node", "v"), ["t", "k", "v"], "left_semi").select("k", "t", "u", "v")


# ---- temporal state -------------------------------------------------------------------------------


@query("core_signatures", "SELECT node, k, round(sum(pow(0.7, 29 - t) * CASE WHEN core <= k THEN core / k ELSE 2 - k / core END) / ((1 - pow(0.7, 30)) / (1 - 0.7)), 6) AS value FROM core, (SELECT CAST(unnest(range(1, kmax + 1)) AS INTEGER) AS k FROM mx) GROUP BY 1, 2", "core mx")
def _(g):
    return history.signatures(g.core, g.n - 1, g.kmax).withColumn("value", r6("value"))


@query("core_signatures_incremental", "SELECT node, k, round(sum(pow(0.7, 29 - t) * CASE WHEN core <= k THEN core / k ELSE 2 - k / core END) / ((1 - pow(0.7, 30)) / (1 - 0.7)), 6) AS value FROM core, (SELECT CAST(unnest(range(1, kmax + 1)) AS INTEGER) AS k FROM mx) GROUP BY 1, 2", "core mx")
def _(g):
    state = g.spark.createDataFrame([], "node long, last_t int, sums array<double>")
    for t in range(g.n):
        state = history.advance(state, g.core.where(F.col("t") == t), t, g.kmax)
        if t % 4 == 3:
            state = kept(state)
    return history.read_state(state, g.n - 1).select("node", F.posexplode("vec").alias("p", "x")).select("node", (F.col("p") + 1).alias("k"), r6("x").alias("value"))


@query("influence_state", f"SELECT src, node, time, round(score, 6) AS score FROM {STATE}", STATE)
def _(g):
    return g.influences[0].withColumn("score", r6("score"))


@query("influence_norms", f"SELECT src, round(norm, 6) AS norm FROM no{SNAPSHOTS - 1}", f"no{SNAPSHOTS - 1}")
def _(g):
    return g.influences[1].withColumn("norm", r6("norm"))


@query("influence_answers", "SELECT src, node, time, round(score, 6) AS score, round(weight, 6) AS weight FROM ans", "ans")
def _(g):
    return g.answers.withColumn("score", r6("score")).withColumn("weight", r6("weight"))


@query("influence_merged", "SELECT src, node, round(score, 6) AS score FROM mg", "mg")
def _(g):
    return influence.merged_scores(g.answers).withColumn("score", r6("score"))


@query("walk_transitions", "SELECT a, b, time, round(w / sum(w) OVER (PARTITION BY a), 6) AS p FROM (SELECT a, b, t AS time, pow(0.5, dense_rank() OVER (PARTITION BY a ORDER BY t DESC) - 1) AS w FROM adj)", "adj")
def _(g):
    return influence.transitions(g.edges, g.n).withColumn("p", r6("p"))


@query("weighted_structure", "SELECT src, block, bucket, round(sum(weight * share), 6) AS value FROM ans JOIN sh ON sh.t = ans.time AND sh.node = ans.node GROUP BY 1, 2, 3", "ans sh")
def _(g):
    return influence.weighted_structure(g.answers, g.shares).withColumn("value", r6("value"))


# ---- samples and features -------------------------------------------------------------------------


@query("time_splits", "SELECT CAST(t AS INTEGER) AS t, CASE WHEN t < a THEN 'train' WHEN t < b THEN 'val' ELSE 'test' END AS split FROM bounds, (SELECT unnest(range(n - 1)) AS t FROM nt)", "bounds")
def _(g):
    a, b = samples.split_bounds(g.n)
    return g.windows.where(F.col("t") < g.n - 1).select("t", samples.split_of(F.col("t"), a, b).alias("split"))


@query("coreness_samples", "SELECT split, node, time, label FROM smp", "smp")
def _(g):
    return samples.coreness_samples(g.core, g.n)


@query("inference_samples", "SELECT node, 12 AS time FROM fs WHERE first_t <= 12", "fs")
def _(g):
    return samples.inference_samples(g.core, 12)


@query("core_history", "SELECT s.node, s.time, CAST(l AS INTEGER) AS lag, coalesce(c.core, 0) AS core FROM smp s CROSS JOIN range(5) AS x(l) LEFT JOIN core c ON c.node = s.node AND c.t = s.time - l", "smp core")
def _(g):
    return samples.core_history(samples.coreness_samples(g.core, g.n), g.core)


@query("round_robin", "SELECT t, node, core FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY turn, core DESC) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY t, core ORDER BY md5(concat_ws(':', 42, t, node))[1:13], node) AS turn FROM core)) WHERE pick <= 25", "core")
def _(g):
    return samples.round_robin(g.core, 25)


@query("stays_and_leaves", "SELECT t, k, count(*) FILTER (stays) AS stays, count(*) FILTER (NOT stays) AS leaves FROM st, nt WHERE t < n - 1 GROUP BY 1, 2", "st nt")
def _(g):
    return samples.stays(g.kcore, g.core).where(F.col("t") < g.n - 1).groupBy("t", "k").agg(F.count_if("stays").alias("stays"), F.count_if(~F.col("stays")).alias("leaves"))


def _cohort(g: Graph) -> DataFrame:
    return g.cohort


@query("cohort", "SELECT query, k, t, empty FROM co", "co")
def _(g):
    return _cohort(g)


@query("cohort_truth", "SELECT co.query, co.k, co.t, count(tr.node) AS size, CAST(coalesce(sum(tr.node), 0) AS BIGINT) AS id_sum FROM co LEFT JOIN tr ON tr.query = co.query AND tr.k = co.k AND tr.t = co.t GROUP BY 1, 2, 3", "co tr")
def _(g):
    rows = samples.truths(_cohort(g), g.kcore)
    return rows.select("query", "k", "t", F.size("community").cast("long").alias("size"), F.aggregate("community", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("cohort_counts", "SELECT k, count(*) AS samples, count(*) FILTER (empty) AS empty_samples FROM co GROUP BY 1", "co")
def _(g):
    return _cohort(g).groupBy("k").agg(F.count(F.lit(1)).alias("samples"), F.count_if("empty").alias("empty_samples"))


@query("cohort_fingerprint", "SELECT sha256(concat('[', string_agg(concat('[', query, ', ', k, ', ', t, ']'), ', ' ORDER BY query, k, t), ']')) AS sha256 FROM co", "co")
def _(g):
    return sets.query_fingerprint(_cohort(g))


@query("cohort_ids", "SELECT concat_ws(':', t, k, query) AS sample_id FROM co", "co")
def _(g):
    return _cohort(g).select(F.concat_ws(":", "t", "k", "query").alias("sample_id"))


@query("cohort_faults", "SELECT query, k, t, 'time' AS fault FROM co, bounds WHERE t < b + 1", "co bounds")
def _(g):
    return samples.check_cohort(samples.truths(_cohort(g), g.kcore), g.n, samples.evaluation_start(g.n) + 1)


@query(
    "stratified_downsample",
    "SELECT query, k, t, empty FROM (SELECT *, row_number() OVER (PARTITION BY t, k, empty ORDER BY md5(concat_ws(':', 42, t, k, query))[1:13], query) AS pick FROM co) JOIN (SELECT t, k, empty, base + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, md5(concat_ws(':', 42, t, k, CAST(empty AS INTEGER)))[1:13]) <= target - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT t, k, empty, floor(count(*) / 3.0::DOUBLE) AS base, count(*) / 3.0::DOUBLE - floor(count(*) / 3.0::DOUBLE) AS rest, greatest(1, round_even((SELECT count(*) FROM co) / 3.0::DOUBLE, 0)) AS target FROM co GROUP BY 1, 2, 3)) USING (t, k, empty) WHERE pick <= quota",
    "co",
)
def _(g):
    return samples.stratified_downsample(_cohort(g), 1 / 3)


# a draw's place among the nodes known at its time, in each of forty rounds; the first round whose pair is none of the snapshot's edges counts
DRAWS = """(SELECT t, u0, v0, p, q FROM (SELECT d.*, row_number() OVER (PARTITION BY d.t, u0, v0 ORDER BY round) AS first FROM
(SELECT e.t, u0, v0, round, least(a.node, b.node) AS p, greatest(a.node, b.node) AS q FROM (SELECT s.t - 1 AS t, s.u AS u0, s.v AS v0, round, CAST(floor({a} * known) AS BIGINT) AS ia, CAST(floor({b} * known) AS BIGINT) AS ib
FROM s JOIN (SELECT s.t - 1 AS t, count(DISTINCT fs.node) AS known FROM (SELECT DISTINCT t FROM s) s JOIN fs ON first_t <= s.t - 1 GROUP BY 1) c ON c.t = s.t - 1, range(40) AS x(round)) e
JOIN (SELECT node, row_number() OVER (ORDER BY first_t, node) - 1 AS i FROM fs) a ON a.i = ia JOIN (SELECT node, row_number() OVER (ORDER BY first_t, node) - 1 AS i FROM fs) b ON b.i = ib) d
LEFT JOIN s ON s.t = d.t + 1 AND s.u = p AND s.v = q WHERE s.u IS NULL AND p <> q) WHERE first = 1)""".format(
    **{side: MD5_UNIT.format(key=f"concat('42:', round, ':{side}'), concat_ws(':', s.t - 1, s.u, s.v)") for side in "ab"}
)


@query("negative_edges", f"SELECT CAST(t AS INTEGER) AS t, p AS u, q AS v FROM {DRAWS}", "s fs")
def _(g):
    return samples.negative_edges(g.edges, g.nodes)


@query(
    "labelled_pairs",
    f"SELECT CASE WHEN t < a THEN 'train' WHEN t < b THEN 'val' ELSE 'test' END AS split, CAST(t AS INTEGER) AS t, u, v, label FROM (SELECT s.t - 1 AS t, s.u, s.v, 1 AS label FROM s JOIN fs x ON x.node = s.u AND x.first_t < s.t JOIN fs y ON y.node = s.v AND y.first_t < s.t UNION ALL SELECT t, p, q, 0 FROM {DRAWS}), bounds",
    "s fs bounds",
)
def _(g):
    return samples.labelled_pairs(g.edges, g.nodes, g.n)


@query("feature_table", "SELECT s.split, s.node, s.time, s.label, coalesce(c.core, 0) AS core_now, coalesce(h.h1, 0) AS h1_now FROM smp s LEFT JOIN core c ON c.node = s.node AND c.t = s.time LEFT JOIN ns h ON h.node = s.node AND h.t = s.time", "smp core ns")
def _(g):
    now = g.state.select("node", F.col("t").alias("time"), F.col("core").alias("core_now"), F.col("h1").alias("h1_now"))
    rows = samples.coreness_samples(g.core, g.n).join(now, ["node", "time"], "left")
    return rows.select("split", "node", "time", "label", F.coalesce("core_now", F.lit(0)).alias("core_now"), F.coalesce("h1_now", F.lit(0)).alias("h1_now"))


# ---- ordinal model pieces and metrics -------------------------------------------------------------

PRED = "(SELECT s.node, s.time, s.label, coalesce(c.core, 0) AS pred FROM smp s LEFT JOIN core c ON c.node = s.node AND c.t = s.time)"


def _persistence(g: Graph) -> DataFrame:
    """The untrained model: logits fall with the distance from today's coreness."""
    rows = samples.coreness_samples(g.core, g.n).join(g.core.withColumnRenamed("t", "time"), ["node", "time"], "left")
    logits = ordinal.persistence_logits(F.coalesce("core", F.lit(0)), g.kmax)
    return rows.withColumn("logits", logits).withColumn("cumulative", ordinal.cumulative_logits(F.col("logits"), g.kmax)).withColumn("pred", ordinal.decode(F.col("cumulative")))


@query("persistence_predictions", f"SELECT node, time, label, pred FROM {PRED}", "smp core")
def _(g):
    return _persistence(g).select("node", "time", "label", "pred")


@query("ordinal_targets", "SELECT node, time, CAST(k AS INTEGER) AS k, CAST(label >= k AS INTEGER) AS target FROM smp, (SELECT unnest(range(1, kmax + 1)) AS k FROM mx)", "smp mx")
def _(g):
    rows = samples.coreness_samples(g.core, g.n)
    return rows.select("node", "time", F.posexplode(ordinal.ordinal_targets(F.col("label"), g.kmax)).alias("p", "target")).select("node", "time", (F.col("p") + 1).alias("k"), "target")


@query("cumulative_logits", f"SELECT node, time, CAST(k AS INTEGER) AS k, round(ln(sum(exp(-2.0 * abs(j - pred))) FILTER (j >= k)) - ln(sum(exp(-2.0 * abs(j - pred))) FILTER (j < k)), 6) AS logit FROM {PRED}, (SELECT unnest(range(1, kmax + 1)) AS k FROM mx), (SELECT unnest(range(kmax + 1)) AS j FROM mx) GROUP BY 1, 2, 3", "smp core mx")
def _(g):
    return _persistence(g).select("node", "time", F.posexplode("cumulative").alias("p", "x")).select("node", "time", (F.col("p") + 1).alias("k"), r6("x").alias("logit"))


@query("positive_weights", "SELECT CAST(k AS INTEGER) AS k, round(CASE WHEN p > 0 AND n > p THEN least(pow(n / p, 0.5), 10.0) ELSE 1.0 END, 6) AS weight FROM (SELECT k, count(*) FILTER (label >= k) AS p, count(*) FILTER (label < k) AS n FROM smp, (SELECT unnest(range(1, kmax + 1)) AS k FROM mx) WHERE split = 'train' GROUP BY 1)", "smp mx")
def _(g):
    return ordinal.positive_weights(samples.coreness_samples(g.core, g.n).where("split = 'train'"), "label", g.kmax).withColumn("weight", r6("weight"))


@query("coreness_accuracy", f"SELECT round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy, round(avg(abs(pred - label)), 6) AS mae FROM {PRED}", "smp core")
def _(g):
    return _persistence(g).agg(r6(F.avg((F.col("pred") == F.col("label")).cast("int"))).alias("accuracy"), r6(F.avg(F.abs(F.col("pred") - F.col("label")))).alias("mae"))


@query(
    "binary_metrics",
    f"SELECT k, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0::DOUBLE END AS r FROM (SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (pred >= k AND label >= k) AS tp, count(*) FILTER (pred >= k AND label < k) AS fp, count(*) FILTER (pred < k AND label >= k) AS fn, count(*) FILTER (pred < k AND label < k) AS tn FROM {PRED}, (VALUES (3), (4), (5), (6), (7)) AS x(k) GROUP BY 1))",
    "smp core",
)
def _(g):
    rows = _persistence(g).withColumn("k", F.explode(F.array(*map(F.lit, samples.KS))))
    out = sets.binary_metrics(rows, F.col("pred") >= F.col("k"), F.col("label") >= F.col("k"), "k")
    return out.select("k", "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("event_quantile", "SELECT round(quantile_cont(CAST(t + 1 AS DOUBLE), 0.85), 6) AS q FROM s", "s")
def _(g):
    return edge_log.export_events(g.edges).agg(r6(F.percentile("ts", F.lit(0.85))).alias("q"))


# ---- communities ----------------------------------------------------------------------------------


@query("candidates", "SELECT query, k, t, node FROM cand", "cand")
def _(g):
    return g.candidates


@query("candidate_sizes", "SELECT k, round(avg(n), 6) AS mean_size, max(n) AS max_size, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT query, k, t, count(*) AS n FROM cand GROUP BY 1, 2, 3) GROUP BY 1", "cand")
def _(g):
    n = g.candidates.groupBy("query", "k", "t").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("k").agg(r6(F.avg("n")).alias("mean_size"), F.max("n").alias("max_size"), F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("pairs"))


@query("execution_order", "SELECT query, k, t, n, row_number() OVER (ORDER BY k DESC, n, t, query) AS place FROM (SELECT query, k, t, count(*) AS n FROM cand GROUP BY 1, 2, 3)", "cand")
def _(g):
    n = g.candidates.groupBy("query", "k", "t").agg(F.count(F.lit(1)).alias("n"))
    n = edge_log.dense_ids(n.withColumn("at", F.struct(-F.col("k"), "n", "t", "query")), "at", "place")
    return n.select("query", "k", "t", "n", (F.col("place") + 1).alias("place"))


@query("candidate_index", "SELECT DISTINCT co.query, co.k, y.node FROM co JOIN kc x ON x.k = co.k AND x.node = co.query JOIN kc y ON y.k = x.k AND y.t = x.t AND y.component_id = x.component_id", "co kc")
def _(g):
    index = g.spark.createDataFrame([], "query long, k int, node long")
    queries = kept(g.cohort.select("query", "k").distinct())
    for t in range(g.n):
        index = communities.extend_index(index, queries, g.kcore, t)
        if t % 4 == 3:
            index = kept(index)
    return index


@query("recovered_components", "SELECT query, k, t, node FROM prc", "prc")
def _(g):
    return communities.recover_components(g.cohort, g.candidates, g.scored, 0.5)


@query("candidate_edges", "SELECT query, k, t, u, v, first_t FROM ce", "ce")
def _(g):
    return communities.candidate_edges(g.candidates, g.edges)


@query("scored_edges", "SELECT query, k, t, u, v, round(score, 6) AS score FROM sc", "sc")
def _(g):
    return g.scored.select("query", "k", "t", "u", "v", r6("score").alias("score"))


@query("link_communities", "SELECT query, k, t, node FROM prc", "prc")
def _(g):
    return g.linked


def _predicted(g: Graph) -> DataFrame:
    return g.core.withColumnRenamed("core", "pred")


@query("bfs_nodes", "SELECT query, k, t, node, pred FROM bn", "bn")
def _(g):
    return g.searched.select("query", "k", "t", "node", "pred")


@query("bfs_communities", "SELECT query, k, t, count(*) AS looked_at, count(*) FILTER (pred >= k) AS size FROM bn GROUP BY 1, 2, 3", "bn")
def _(g):
    return g.searched.groupBy("query", "k", "t").agg(F.count(F.lit(1)).alias("looked_at"), F.count_if("inside").alias("size"))


def _evaluated(g: Graph, members: DataFrame) -> DataFrame:
    """Metrics of each query's members (query, k, t, node) against its truth, queries of empty truth left out."""
    total = g.nodes.select("node").distinct().count()
    rows = sets.counted(g.cohort.select("query", "k", "t"), members, samples.truth_members(g.cohort, g.kcore), ["query", "k", "t"], ["node"]).where(F.col("true") > 0)
    m = sets.count_metrics(F.col("hit"), F.col("found"), F.col("true"))
    return rows.select("query", "k", "t", *(c.alias(n) for n, c in m.items()), (F.col("found") / F.col("true")).alias("size_ratio"), (F.col("found") / F.lit(total) * 100).alias("pred_ratio"))


def _metrics_sql(members: str) -> str:
    return f"""(SELECT query, k, t, CASE WHEN f = 0 THEN 0 ELSE hit / f END AS precision, CASE WHEN f = 0 THEN 0 ELSE hit / n END AS recall, CASE WHEN f = 0 THEN 0 ELSE 2.0::DOUBLE * hit / (f + n) END AS f1,
CASE WHEN f = 0 THEN 0 ELSE hit / (f + n - hit) END AS jaccard, f / n AS size_ratio, f / (SELECT count(DISTINCT node) FROM nd) * 100 AS pred_ratio FROM (SELECT a.query, a.k, a.t, a.n, coalesce(b.f, 0) AS f, coalesce(c.hit, 0) AS hit FROM (SELECT query, k, t, count(*) AS n FROM tr GROUP BY 1, 2, 3) a
LEFT JOIN (SELECT query, k, t, count(*) AS f FROM {members} GROUP BY 1, 2, 3) b USING (query, k, t) LEFT JOIN (SELECT query, k, t, count(*) AS hit FROM {members} JOIN tr USING (query, k, t, node) GROUP BY 1, 2, 3) c USING (query, k, t)))"""


METRICS = ("precision", "recall", "f1", "jaccard", "size_ratio", "pred_ratio")
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
BFS = "(SELECT query, k, t, node FROM bn WHERE pred >= k)"


def _bfs_members(g: Graph) -> DataFrame:
    return g.searched.where("inside").select("query", "k", "t", "node")


@query("hybrid_metrics", f"SELECT query, k, t, {ROUNDED} FROM {_metrics_sql(BFS)}", "bn tr nd")
def _(g):
    rows = _evaluated(g, _bfs_members(g))
    return rows.select("query", "k", "t", *(r6(m).alias(m) for m in METRICS))


@query("hybrid_per_k", f"SELECT k, count(*) AS samples, {MEANS} FROM {_metrics_sql(BFS)} GROUP BY 1", "bn tr nd")
def _(g):
    return _evaluated(g, _bfs_members(g)).groupBy("k").agg(F.count(F.lit(1)).alias("samples"), *(r6(F.avg(m)).alias(m) for m in METRICS))


@query("hybrid_macro", f"SELECT {MEANS} FROM (SELECT k, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM {_metrics_sql(BFS)} GROUP BY 1)", "bn tr nd")
def _(g):
    per_k = _evaluated(g, _bfs_members(g)).groupBy("k").agg(*(F.avg(m).alias(m) for m in METRICS))
    return per_k.agg(*(r6(F.avg(m)).alias(m) for m in METRICS))


@query("link_per_k", f"SELECT k, count(*) AS samples, {MEANS} FROM {_metrics_sql('prc')} GROUP BY 1", "prc tr nd")
def _(g):
    return _evaluated(g, g.linked).groupBy("k").agg(F.count(F.lit(1)).alias("samples"), *(r6(F.avg(m)).alias(m) for m in METRICS))


@query("hybrid_audit", "SELECT t, count(DISTINCT (query, k)) AS queries, count(*) AS examined, count(DISTINCT node) AS predictions, count(*) - count(DISTINCT node) AS repeated FROM bn GROUP BY 1", "bn")
def _(g):
    """Totals of an evaluation: nodes examined, and how many predictions they needed."""
    n = g.searched.groupBy("t").agg(F.countDistinct("query", "k").alias("queries"), F.count(F.lit(1)).alias("examined"), F.countDistinct("node").alias("predictions"))
    return n.withColumn("repeated", F.col("examined") - F.col("predictions"))


# ---- edge generation ------------------------------------------------------------------------------


@query("two_hop_scores", "SELECT a.src, b.node, round(sum(a.score * b.score), 6) AS score FROM mg a JOIN mg b ON b.src = a.node WHERE a.src <> a.node AND b.src <> b.node AND b.node <> a.src GROUP BY 1, 2", "mg")
def _(g):
    return edge_generation.two_hop_scores(influence.merged_scores(g.answers)).withColumn("score", r6("score"))


DIRECT = "(SELECT DISTINCT src, node FROM mg WHERE src <> node)"


@query("score_dependents", f"SELECT DISTINCT node, dependent FROM (SELECT node, src AS dependent FROM {DIRECT} UNION ALL SELECT a.node, b.src FROM {DIRECT} a JOIN {DIRECT} b ON b.node = a.src) WHERE node <> dependent", "mg")
def _(g):
    return edge_generation.dependents(influence.merged_scores(g.answers))


NEAR = "(SELECT m.t, m.src, m.node, m.score, p.core AS c FROM mga m JOIN core p ON p.t = m.t AND p.node = m.node WHERE m.src <> m.node)"
CAPACITY = f"(SELECT p.t, p.node, p.core AS pred, coalesce(q.capacity, 0) AS capacity FROM core p JOIN bounds ON p.t >= b LEFT JOIN (SELECT t, src, count(*) FILTER (c >= rn) AS capacity FROM (SELECT *, row_number() OVER (PARTITION BY t, src ORDER BY c DESC) AS rn FROM {NEAR}) GROUP BY 1, 2) q ON q.t = p.t AND q.src = p.node)"


def _pred(g: Graph) -> DataFrame:
    """Today's coreness as the prediction, at every evaluation time and after the last snapshot."""
    return g.core.where(F.col("t") >= samples.evaluation_start(g.n)).select("t", "node", F.col("core").alias("pred"))


@query("choice_capacity", f"SELECT t, node, pred, CAST(capacity AS INTEGER) AS capacity FROM {CAPACITY}", "mga core bounds")
def _(g):
    return edge_generation.capacities(_pred(g), g.merged)


@query("first_choices", f'SELECT t, node, candidate, "case" FROM (SELECT p.t, p.node, m.node AS candidate, CASE WHEN capacity > pred THEN 2 ELSE 1 END AS "case", pred, row_number() OVER (PARTITION BY p.t, p.node ORDER BY round(score, 14) DESC, m.node) AS r FROM {CAPACITY} p JOIN {NEAR} m ON m.t = p.t AND m.src = p.node AND c >= pred WHERE pred > 0 AND capacity >= pred) WHERE "case" = 1 OR r <= pred', "mga core bounds")
def _(g):
    return edge_generation.first_choices(_pred(g), g.merged)


@query("generated_edges")
def _(g):
    return g.generated


@query("generated_case_metrics")
def _(g):
    return edge_generation.case_metrics(g.generated)


TRUE_EDGES = ["query", "k", "t"], ["u", "v"]


def _true_edges(g: Graph) -> DataFrame:
    """(query, k, t, u, v): edges of t + 1 inside each query's true community."""
    truth = samples.truth_members(g.cohort, g.kcore)
    after = g.edges.select((F.col("t") - 1).alias("t"), "u", "v").join(truth.withColumnRenamed("node", "u"), ["t", "u"])
    return after.join(truth.withColumnRenamed("node", "v"), ["query", "k", "t", "v"], "left_semi").select("query", "k", "t", "u", "v")


def _edge_metrics(g: Graph, found: DataFrame) -> DataFrame:
    rows = sets.counted(g.cohort.where("not empty").select("query", "k", "t"), found, _true_edges(g), *TRUE_EDGES)
    m = sets.count_metrics(F.col("hit"), F.col("found"), F.col("true"))
    return rows.select("query", "k", "t", *(r6(c).alias(n) for n, c in m.items()))


@query("generated_edge_metrics")
def _(g):
    """Generated edges against the edges of the next snapshot's true community."""
    return _edge_metrics(g, g.generated.where("u is not null"))


# ---- more evaluation and features -----------------------------------------------------------------

EXACT = influence_parts(SNAPSHOTS, top=10**9, least=-1, x="x")


@query("influence_exact", f"SELECT src, node, time, round(score, 9) AS score FROM {EXACT}", EXACT)
def _(g):
    """The exact walk as of the last snapshot, from every node; its SQL is the streaming recurrence without bounds."""
    return influence.exact(g.edges, g.nodes.select("node").distinct(), g.n - 1, digits=9)


@query("influence_exact_top", f"SELECT src, node, time, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 14) DESC, time DESC, node) AS r FROM {EXACT}) WHERE r <= 20", EXACT)
def _(g):
    return influence.exact(g.edges, g.nodes.select("node").distinct(), g.n - 1, top=20, digits=9)


@query("influence_at_times", "SELECT DISTINCT a.t, src, node, time, round(score, 6) AS score, round(weight, 6) AS weight FROM ansall a JOIN co ON co.query = a.src AND co.t = a.t", "ansall co")
def _(g):
    """The answers of every query of the cohort at its own time."""
    queries = g.cohort.select(F.col("query").alias("src"), "t").distinct()
    times = sorted(r.t for r in queries.select("t").distinct().collect())  # evaluation times
    return influence.answers_at(g.edges, queries, times).withColumn("score", r6("score")).withColumn("weight", r6("weight"))


@query("influence_ages", "SELECT t, src, node, time, round(ln(1 + t - time), 6) AS age FROM ansall", "ansall")
def _(g):
    return influence.log_ages(g.all_answers).select("t", "src", "node", "time", r6("age").alias("age"))


@query("feature_signatures", "SELECT s.node, s.time, k, round(sum(pow(0.7, s.time - t) * CASE WHEN core <= k THEN core / k ELSE 2 - k / core END) / ((1 - pow(0.7, s.time + 1)) / (1 - 0.7)), 6) AS value FROM smp s JOIN core c ON c.node = s.node AND c.t <= s.time, (SELECT CAST(unnest(range(1, kmax + 1)) AS INTEGER) AS k FROM mx) GROUP BY 1, 2, 3", "smp core mx")
def _(g):
    return features.signatures_at(samples.coreness_samples(g.core, g.n), g.core, g.kmax).withColumn("value", r6("value"))


@query("feature_rows", "SELECT split, node, time, label, CAST(place AS INTEGER) AS place, round(value, 6) AS value FROM smp JOIN fv USING (node, time)", "smp fv")
def _(g):
    """Every sample's whole features, a row for each that isn't 0."""
    return g.features.select("split", "node", "time", "label", F.posexplode("features").alias("place", "value")).where("value <> 0").withColumn("value", r6("value"))


@query("feature_inference", "SELECT node, time, CAST(place AS INTEGER) AS place, round(value, 6) AS value FROM fv, nt WHERE time = n - 2", "fv nt")
def _(g):
    """Features of all nodes known at one time, to predict what follows it."""
    return features.feature_values(samples.inference_samples(g.core, g.n - 2), g.core, g.state, g.kmax, g.all_answers, g.shares, g.hmax).withColumn("value", r6("value"))


@query("feature_on_demand", "SELECT DISTINCT node, time, CAST(place AS INTEGER) AS place, round(value, 6) AS value FROM fv JOIN co ON co.query = node AND co.t = time", "fv co")
def _(g):
    """Features of the cohort's queries only, at their own times."""
    wanted = g.cohort.select(F.col("query").alias("node"), F.col("t").alias("time")).distinct()
    return features.feature_values(wanted, g.core, g.state, g.kmax, g.all_answers, g.shares, g.hmax).withColumn("value", r6("value"))


@query("structure_table", "SELECT t, node, block, bucket, round(share, 6) AS share FROM sh SEMI JOIN (SELECT time AS t, node FROM ansall) USING (t, node)", "sh ansall")
def _(g):
    return features.structure_table(g.all_answers, g.shares).withColumn("share", r6("share"))


WEIGHT = "((k * 7 + place * 3) % 5 - 2) * 0.01"


def _fixed_model(g: Graph) -> features.Predictor:
    """Weights that are given and not learnt: the forward pass alone."""
    m = features.Predictor.untrained(g.kmax, features.feature_width(g.kmax, g.hmax))
    m.weights = [[((k * 7 + i * 3) % 5 - 2) * 0.01 for i in range(len(m.mean))] for k in range(1, g.kmax + 1)]
    m.bias = [0.1 * (k % 3 - 1) for k in range(1, g.kmax + 1)]
    return m


@query(
    "model_predictions",
    f"""SELECT s.node, s.time, s.label, CAST(count(*) FILTER (round(prior + coalesce(x, 0) + 0.1 * (z.k % 3 - 1), 9) > 0) AS INTEGER) AS pred FROM
(SELECT node, time, label, CAST(k AS INTEGER) AS k, ln(sum(exp(-2.0 * abs(j - pred))) FILTER (j >= k)) - ln(sum(exp(-2.0 * abs(j - pred))) FILTER (j < k)) AS prior FROM {PRED}, (SELECT unnest(range(1, kmax + 1)) AS k FROM mx), (SELECT unnest(range(kmax + 1)) AS j FROM mx) GROUP BY 1, 2, 3, 4) s
JOIN (SELECT CAST(unnest(range(1, kmax + 1)) AS INTEGER) AS k FROM mx) z ON z.k = s.k LEFT JOIN (SELECT node, time, k, sum(value * {WEIGHT}) AS x FROM fv, (SELECT CAST(unnest(range(1, kmax + 1)) AS INTEGER) AS k FROM mx) GROUP BY 1, 2, 3) f ON f.node = s.node AND f.time = s.time AND f.k = s.k GROUP BY 1, 2, 3""",
    "smp core mx fv",
)
def _(g):
    return _fixed_model(g).predict(g.features).select("node", "time", "label", "pred")


@query("trained_predictions")
def _(g):
    return g.predictor.predict(g.features.where("split = 'test'")).select("node", "time", "label", "pred")


@query("trained_communities")
def _(g):
    """Breadth-first communities under the trained predictor."""
    return g.searched_by_model.select("query", "k", "t", "node", "pred")


@query("trained_metrics")
def _(g):
    rows = _evaluated(g, g.searched_by_model.where("inside").select("query", "k", "t", "node"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("samples"), *(r6(F.avg(m)).alias(m) for m in METRICS))


@query("trained_edges")
def _(g):
    """Nodes and edges at every query time: the trained predictor's communities and the edges generated inside them."""
    return g.generated_by_model


@query("threshold_components", "SELECT t, k, node, l AS component_id FROM okl WHERE it = 12", "okl")
def _(g):
    return communities.cumulative_components(_predicted(g), g.edges, samples.KS)


@query(
    "link_edge_metrics",
    """SELECT query, k, t, round(CASE WHEN p = 0 AND n = 0 THEN 1 WHEN p = 0 OR n = 0 THEN 0 ELSE hit / p END, 6) AS precision, round(CASE WHEN p = 0 AND n = 0 THEN 1 WHEN p = 0 OR n = 0 THEN 0 ELSE hit / n END, 6) AS recall FROM (SELECT q.query, q.k, q.t,
(SELECT count(*) FROM fe WHERE fe.query = q.query AND fe.k = q.k AND fe.t = q.t) AS p, (SELECT count(*) FROM te WHERE te.query = q.query AND te.k = q.k AND te.t = q.t) AS n,
(SELECT count(*) FROM fe JOIN te USING (query, k, t, u, v) WHERE query = q.query AND k = q.k AND t = q.t) AS hit FROM co q WHERE NOT q.empty)""",
    "co fe te",
)
def _(g):
    key = ["query", "k", "t"]
    found = g.scored.where(communities.over(F.col("score"), 0.5, False)).select(*key, "u", "v")
    for side in "uv":
        found = found.join(g.linked.select(*key, F.col("node").alias(side)), [*key, side], "left_semi")
    return _edge_metrics(g, found).select(*key, "precision", "recall")


LINKED = "(SELECT sc.query, sc.k, sc.t, sc.u, sc.v, round(score, 9) AS score, s.u IS NOT NULL AS linked FROM sc LEFT JOIN s ON s.t = sc.t + 1 AND s.u = sc.u AND s.v = sc.v)"


def _linked(g: Graph) -> DataFrame:
    """(score, linked, queries): scored edges, and whether they are in the next snapshot; a row stands for all queries of its mask."""
    rows = communities.by_mask(*g.scored_pairs)
    return rows.select(F.round("score", 9).alias("score"), F.array_contains("met", F.col("t") + 1).alias("linked"), F.bit_count("mask").alias("queries"))


@query("link_auc", f"SELECT round((sum(r) FILTER (linked) - count(*) FILTER (linked) * (count(*) FILTER (linked) + 1) / 2) / (count(*) FILTER (linked) * count(*) FILTER (NOT linked)), 6) AS auc FROM (SELECT linked, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM {LINKED})", "sc s")
def _(g):
    return ranking.auc(_linked(g), "score", "linked", "queries").select(r6("auc").alias("auc"))


@query("link_average_precision", f"SELECT round(sum(p * pp / nn) / sum(p), 6) AS ap FROM (SELECT p, sum(p) OVER (ORDER BY score DESC) AS pp, sum(n) OVER (ORDER BY score DESC) AS nn FROM (SELECT score, count(*) AS n, count(*) FILTER (linked) AS p FROM {LINKED} GROUP BY 1))", "sc s")
def _(g):
    return ranking.average_precision(_linked(g), "score", "linked", "queries").select(r6("ap").alias("ap"))


@query("pair_scores", "SELECT s.t, a.node AS u, b.node AS v, round(1 / (1 + exp(-(0.2 * greatest(0.1 * a.degree - 0.3 * b.core + 0.05, 0) - 0.15 * greatest(0.25 * a.h1 + 0.2 * b.h1 - 1, 0)))), 6) AS score FROM s JOIN ns a ON a.t = s.t AND a.node = s.u JOIN ns b ON b.t = s.t AND b.node = s.v", "s ns")
def _(g):
    nodes = g.state.select("t", "node", F.array(*(F.col(c).cast("double") for c in ("degree", "h1", "core"))).alias("vector"))
    out = ranking.pair_decoder(g.edges, nodes, [[0.1, 0.0, 0.0], [0.0, 0.25, 0.0]], [[0.0, 0.0, -0.3], [0.0, 0.2, 0.0]], [0.05, -1.0], [0.2, -0.15], ("t",))
    return out.withColumn("score", r6("score"))


@query("symmetric_scores", "SELECT s.t, s.u, s.v, round((1 / (1 + exp(-(0.1 * a.degree - 0.2 * b.core))) + 1 / (1 + exp(-(0.1 * b.degree - 0.2 * a.core)))) / 2, 6) AS score FROM s JOIN ns a ON a.t = s.t AND a.node = s.u JOIN ns b ON b.t = s.t AND b.node = s.v", "s ns")
def _(g):
    """A directed score made undirected."""
    a, b = (g.state.select("t", F.col("node").alias(x), F.col("degree").alias(f"d{x}"), F.col("core").alias(f"c{x}")) for x in "uv")
    rows = g.edges.join(a, ["t", "u"]).join(b, ["t", "v"])
    uv, vu = (ordinal.sigmoid(0.1 * F.col(f"d{x}") - 0.2 * F.col(f"c{y}")) for x, y in ("uv", "vu"))
    return rows.select("t", "u", "v", r6(ranking.both_ways(uv, vu)).alias("score"))


@query("capped_edges", "SELECT t, u, v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY md5(concat_ws(':', 42, t, u, v))[1:13], u, v) AS r FROM s) WHERE r <= 50", "s")
def _(g):
    order = Window.partitionBy("t").orderBy(samples.unit(F.lit(42), "t", "u", "v"), "u", "v")
    return g.edges.withColumn("r", F.row_number().over(order)).where("r <= 50").select("t", "u", "v")


@query("sample_prefix", "SELECT query, k, t FROM co ORDER BY t, k, query LIMIT 10", "co")
def _(g):
    return _cohort(g).orderBy("t", "k", "query").limit(10).select("query", "k", "t")


DONE = "(SELECT query, k, t, query / 10.0::DOUBLE AS m FROM co WHERE k < 5 OR query % 2 = 0)"


@query("progress", f"SELECT k, count(*) AS total, count(d.m) AS completed, CASE WHEN count(*) = count(d.m) THEN round(avg(d.m), 6) ELSE 'inf'::DOUBLE END AS value FROM co LEFT JOIN {DONE} d USING (query, k, t) GROUP BY 1", "co")
def _(g):
    cohort = _cohort(g)
    done = cohort.where("k < 5 or query % 2 = 0").withColumn("m", F.col("query") / 10.0)
    return features.progress(cohort, done, "m").withColumn("value", F.round("value", 6))


@query("pending", f"SELECT query, k, t FROM co EXCEPT SELECT query, k, t FROM {DONE}", "co")
def _(g):
    cohort = _cohort(g)
    return features.pending(cohort, cohort.where("k < 5 or query % 2 = 0")).select("query", "k", "t")
