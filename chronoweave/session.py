"""Session defaults for tests, the benchmark and local use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 4, name: str = "chronoweave", shuffle: int | None = None, memory: str = "6g") -> SparkSession:
    """A local session; on a cluster the caller brings a session with its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
