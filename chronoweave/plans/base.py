"""Tables that most graph queries share, made once for each session and input."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import communities, cores, edge_generation, features, influence, samples, snapshots, structure
from ..sources import edge_log
from ..tables import kept as _kept

class Graph:
    """The events table's edge log in windows of two days, one day apart."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def log(self) -> DataFrame:
        return _kept(edge_log.event_edges(self.spark, self.dir))

    @cached_property
    def windows(self) -> DataFrame:
        return _kept(snapshots.windows(self.log))

    @cached_property
    def n(self) -> int:
        return self.windows.count()

    @cached_property
    def members(self) -> DataFrame:
        return _kept(snapshots.members(self.log))

    @cached_property
    def edges(self) -> DataFrame:
        return _kept(snapshots.snapshot_edges(self.members), by="t")

    @cached_property
    def nodes(self) -> DataFrame:
        return _kept(snapshots.snapshot_nodes(self.members))

    @cached_property
    def core(self) -> DataFrame:
        return _kept(cores.with_core(self.nodes, cores.coreness(self.edges)))

    @cached_property
    def min_core(self) -> DataFrame:
        return _kept(cores.edge_cores(self.edges, self.core))

    @cached_property
    def kcore(self) -> DataFrame:
        return _kept(cores.kcore_components(self.min_core))

    @cached_property
    def state(self) -> DataFrame:
        return _kept(structure.node_state(self.edges, self.core))

    @cached_property
    def kmax(self) -> int:
        return self.core.agg(F.max("core")).first()[0]

    @cached_property
    def hmax(self) -> int:
        return self.state.agg(F.max("h1")).first()[0]

    @cached_property
    def shares(self) -> DataFrame:
        return _kept(structure.structure(self.edges, self.state, self.hmax))

    @cached_property
    def cohort(self) -> DataFrame:
        return _kept(samples.cohort(self.kcore, self.core, self.n, samples.evaluation_start(self.n)))

    @cached_property
    def candidates(self) -> DataFrame:
        return _kept(communities.candidates(self.cohort, self.kcore))

    @cached_property
    def scored_pairs(self) -> tuple[DataFrame, DataFrame]:
        """Queries by mask, and scored past edges with the masks of the queries whose candidates hold them."""
        return communities.scored_pairs(self.cohort, self.kcore, self.edges)

    @property
    def scored(self) -> DataFrame:
        """(query, k, t, u, v, first_t, score): made anew by each reader, as it has queries x edges rows."""
        return communities.dealt(*self.scored_pairs)

    @cached_property
    def linked(self) -> DataFrame:
        """Communities of the cohort from scored past edges."""
        return _kept(communities.link_communities(self.cohort, self.kcore, self.edges))

    @cached_property
    def searched_parts(self) -> tuple[DataFrame, DataFrame]:
        return communities.searched_parts(self.cohort, self.edges, self.core.withColumnRenamed("core", "pred"))

    @property
    def searched(self) -> DataFrame:
        """Nodes that breadth-first search from the cohort looks at, coreness staying as it is; made anew by each reader, as it has queries x nodes rows."""
        return communities.dealt_parts(*self.searched_parts)

    @cached_property
    def _influence_pass(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Answers after every snapshot, and state and norms after the last, from one pass."""
        times = list(range(self.n))
        if self.edges.count() <= influence.WALK_EDGES:
            rows = _kept(influence.answers_in_one_pass(self.edges, times))
            last = rows.where(F.col("t") == times[-1])
            state = last.where("node is not null").select("src", "node", "time", "score")
            return rows.where("node is not null"), state, last.where("node is null").select("src", F.col("score").alias("norm"))
        rows = state = norms = None
        for t, state, norms in influence.stream(self.edges, list(range(self.n))):
            now = state.select(F.lit(t).alias("t"), "src", "node", "time", "score")
            rows = now if rows is None else rows.union(now)
        return _kept(influence.top_answers(rows, by=("t", "src")), by="t"), state, norms

    @property
    def all_answers(self) -> DataFrame:
        """(t, src, node, time, score, weight): answers of every source after every snapshot."""
        return self._influence_pass[0]

    @property
    def influences(self) -> tuple[DataFrame, DataFrame]:
        """State and norms after the last snapshot."""
        return self._influence_pass[1:]

    @cached_property
    def merged(self) -> DataFrame:
        """(t, src, node, score): answers with times summed, at every evaluation time and after the last snapshot."""
        rows = self.all_answers.where(F.col("t") >= samples.evaluation_start(self.n))
        return rows.groupBy("t", "src", "node").agg(F.sum("score").alias("score"))

    @cached_property
    def generated(self) -> DataFrame:
        """Edges of the cohort's communities at every query time, each from influences after the snapshots up to it."""
        return self._dealt_edges(*self.searched_parts)

    def _dealt_edges(self, of: DataFrame, found: DataFrame) -> DataFrame:
        """Edges depend on a community's nodes and k alone, so they are generated once for all queries that share it."""
        members = found.where("inside").select(F.col("part").alias("query"), "k", "t", "node", "pred")
        made = _kept(edge_generation.generate_edges(members, self.merged))
        return communities.dealt_parts(of, made.withColumnRenamed("query", "part"))

    @cached_property
    def generated_by_model(self) -> DataFrame:
        return self._dealt_edges(*self.searched_parts_by_model)

    @cached_property
    def answers(self) -> DataFrame:
        return _kept(influence.top_answers(self.influences[0]))

    @cached_property
    def samples(self) -> DataFrame:
        return _kept(samples.coreness_samples(self.core, self.n))

    @cached_property
    def features(self) -> DataFrame:
        """Samples with whole features."""
        of = (self.core, self.state, self.kmax, self.all_answers, self.shares, self.hmax)
        return _kept(features.feature_rows(self.samples, *of, width=features.feature_width(self.kmax, self.hmax)))

    @cached_property
    def predictor(self) -> features.Predictor:
        return features.fit_predictor(self.features, self.kmax, hmax=self.hmax)

    @cached_property
    def predicted(self) -> DataFrame:
        """(t, node, pred) of the trained predictor at every evaluation time."""
        rows = self.predictor.predict(self.features.where(F.col("time") >= samples.evaluation_start(self.n)))
        return _kept(rows.select(F.col("time").alias("t"), "node", "pred"))

    @cached_property
    def searched_parts_by_model(self) -> tuple[DataFrame, DataFrame]:
        return communities.searched_parts(self.cohort, self.edges, self.predicted)

    @property
    def searched_by_model(self) -> DataFrame:
        """Nodes that breadth-first search from the cohort looks at under the trained predictor."""
        return communities.dealt_parts(*self.searched_parts_by_model)


_KNOWN: dict[tuple, Graph] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """What the input's files are: another input under the same path is another graph."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    key = (spark.sparkContext.applicationId, sf_dir, _version(spark, sf_dir))
    if key not in _KNOWN:
        _KNOWN[key] = Graph(spark, sf_dir)
    return _KNOWN[key]
