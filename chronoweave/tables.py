"""Tables written once to the folder all executors see, and read again: short plans, and a lost executor takes nothing with it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[tuple[SparkSession, str]] = []
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset, in a local run."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() write to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends; the caller's setting comes back."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """`df` written and read again; `by` names a column of few values whose filters then skip whole folders."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._chronoweave_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes a table that `kept` made, once nothing reads it any more."""
    if path := getattr(df, "_chronoweave_path", None):
        _delete(df.sparkSession, path)


def _clear() -> None:
    for spark, path in _PATHS:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


atexit.register(_clear)
