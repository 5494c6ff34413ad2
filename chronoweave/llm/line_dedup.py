"""Line dedup by site-relative frequency: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import place, renamed, written

RATIO, MIN_PAGES, BROADCAST_ROWS = 0.1, 5, 50_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    """128 bits of a line, white space at its ends left out."""
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit(7), _bare(line)).alias("b"))


def boilerplate_lines(pages: DataFrame, text: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): for each host the keys of lines on more than `ratio` of its pages and on at least `min_pages`.

    A host has at most (mean lines per page / ratio) such lines, so `keys` doesn't grow with the host.
    Counts are summed before the shuffle, so a line on a third of all pages moves one row per task.
    """
    base = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _bare(x) != ""), _key))
    seen = base.select("host", F.explode(keys).alias("k")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    total = base.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return seen.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("k").alias("keys"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, and `lines_in`, `lines_dropped` added.

    A line counts once for each page (row) that has it; white space at its ends doesn't count;
    blank lines are never boilerplate. A null host is one host of its own, a null text stays
    null with no lines, an empty text is one blank line. Rows with equal ids are separate pages.
    Other columns pass through, whatever their names; existing `lines_in` and `lines_dropped` are replaced.
    The table of boilerplate lines is written first; it is broadcast only if it is small.
    """
    rows, names = renamed(pages, ["lines_in", "lines_dropped"])
    text, host = (f"c{place(names, c)}" for c in (text, host))
    found = written(boilerplate_lines(rows, text, host, ratio, min_pages), "boilerplate")
    size = found.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    docs = rows.withColumn("host", F.coalesce(F.col(host), F.lit(""))).join(F.broadcast(found) if size <= BROADCAST_ROWS else found, "host", "left")
    lines = _lines(F.col(text))
    docs = docs.withColumn("kept", F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("keys"), _key(x)))))
    n_in = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_out = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("kept")).cast("long")
    new = F.array_join("kept", "\n")
    return docs.select(*[new.alias(c) if c == text else c for c in rows.columns], n_in.alias("n_in"), (n_in - n_out).alias("n_dropped")).toDF(*names, "lines_in", "lines_dropped")
