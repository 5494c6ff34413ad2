"""Shared helpers: the folder all executors see, cut lineage, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import chunks

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWNED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where it is unset, in a local run."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _OWNED:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


atexit.register(_drop_all)


def table_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/chronoweave-{uuid.uuid4().hex}/{tag}"
    _OWNED.append((spark, path))
    return path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage; the caller's setting comes back."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = table_path(df.sparkSession, tag)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._chronoweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `written` made, once nothing reads it any more."""
    if path := getattr(df, "_chronoweave_path", None):
        drop_path(df.sparkSession, path)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows: texts are long, and what is made of a batch is held whole. Spark bounds a batch's own bytes (arrow.maxBytesPerBatch)."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that isn't taken, however the caller's are written."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def fields(df: DataFrame) -> str:
    """The columns as a schema string, each followed by a comma."""
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema)


def renamed(df: DataFrame, leave: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """`df` under the names c0, c1, ... without the columns `leave`, and its own names: whatever they are, none clashes with ours."""
    out, low = {c.lower() for c in leave}, [c.lower() for c in df.columns]
    at = [i for i, c in enumerate(low) if c not in out]
    return df.toDF(*[f"c{i}" for i in range(len(low))]).select(*[f"c{i}" for i in at]).toDF(*[f"c{k}" for k in range(len(at))]), [df.columns[i] for i in at]


def place(names: list[str], column: str) -> int:
    """Where a column stands; by its exact name, or else as Spark resolves it, whatever the case."""
    return names.index(column) if column in names else [n.lower() for n in names].index(column.lower())


def with_made(df: DataFrame, column: str, make: Callable[[list], list[pa.Array]], new: str) -> DataFrame:
    """`df` with the columns `new` ("name type, ..."), which make(values of `column`) gives for some rows at a time.

    Existing columns of these names are replaced; all others pass, whatever their names.
    """
    made = [f.rsplit(" ", 1) for f in new.split(", ")]
    rows, names = renamed(df, [n for n, _ in made if n.lower() != column.lower()])
    at = place(names, column)
    labels = [*rows.columns, *(f"n{k}" for k in range(len(made)))]

    def run(batches):
        for b in small_batches(batches):
            values = b.column(at).to_pylist()
            for a, z in chunks(values):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns), *make(values[a:z])], labels)

    out = rows.mapInArrow(run, fields(rows) + ", ".join(f"n{k} {t}" for k, (_, t) in enumerate(made)))
    again = [k for k, n in enumerate(names) if n.lower() in {m.lower() for m, _ in made}]
    out = out.drop(*[f"c{k}" for k in again])
    return out.toDF(*[n for k, n in enumerate(names) if k not in again], *[n for n, _ in made])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary array and the offsets of its rows; null counts as empty."""
    big = isinstance(column, pa.ChunkedArray)
    if big:
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if n else raw[:0], offsets - offsets[0] if n else np.zeros(1, np.int64)


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of an undirected edge table (a, b) of longs; component is the smallest node.

    Each round every node joins its neighbour of least hashed rank and the edges are rewritten
    between the joined nodes, so the edge table shrinks by a constant factor each round in
    expectation, whatever the ids. Nothing but a count comes to the driver. Null ends and loops
    add no link; repeated edges count once. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").distinct(), f"{tag}-edges")
    maps = written(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("root")), f"{tag}-map0")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    e0, k = e.where("a <> b"), 0
    while not e0.isEmpty():
        k += 1
        both = e0.union(e0.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a")).getField("v").alias("to"))
        step = written(best, f"{tag}-step{k}")
        # two hops of the pointer per round
        hop = step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.v"), "left").select(F.col("x.v").alias("v"), F.coalesce("y.to", "x.to").alias("to"))
        hop = written(hop, f"{tag}-hop{k}")
        new = e0.join(hop.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(hop.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        new = written(new.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{tag}-edges{k}")
        moved = maps.join(hop.select(F.col("v").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        maps_new = written(moved, f"{tag}-map{k}")
        for old in (step, hop, maps, e0 if k > 1 else None):
            if old is not None:
                discard(old)
        e0, maps = new, maps_new
    least = maps.groupBy("root").agg(F.min("node").alias("component"))
    return maps.join(least, "root").select("node", "component")


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
