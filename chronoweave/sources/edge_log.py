"""Temporal edge logs (u, v, ts): readers of raw formats, standardisation, checks and writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import kept

EDGE_SCHEMA = T.StructType([T.StructField(c, T.LongType(), False) for c in ("u", "v", "ts")])
MANIFEST_KEYS = ("dataset", "step_seconds", "window_seconds", "first_timestamp", "last_timestamp", "observation_end", "window_alignment", "planned_slice_count", "slice_count", "slices")


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """A standardised log: the header is u,v,ts and every record is three integers, or the read fails."""
    return spark.read.schema(EDGE_SCHEMA).option("enforceSchema", "false").csv(path, header=True, mode="FAILFAST")


def read_slices(spark: SparkSession, root: str) -> DataFrame:
    """(t, u, v, ts) of a folder with a file of edges for each slice, numbered by the digits of its name."""
    rows = spark.read.schema(EDGE_SCHEMA).option("enforceSchema", "false").csv(root, header=True, mode="FAILFAST")
    return rows.select(F.regexp_extract("_metadata.file_name", r"(\d+)[^0-9]*$", 1).cast("int").alias("t"), "u", "v", "ts")


def load_edges(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """(t, u, v, ts) of a store of slices: files of their own, or one log that the manifest's slices cut."""
    if manifest is None:
        return read_slices(spark, path)
    slices = spark.createDataFrame([(k, s["start_ts"], s["end_ts"]) for k, s in enumerate(manifest["slices"])], "t int, start_ts long, end_ts long")
    step, window, s0 = manifest["step_seconds"], manifest["window_seconds"], manifest["observation_end"] - manifest["window_seconds"] - (manifest["planned_slice_count"] - 1) * manifest["step_seconds"]
    last = F.least(F.lit(manifest["planned_slice_count"] - 1), F.floor((F.col("ts") - s0) / F.lit(step)))
    first = F.greatest(F.lit(0), F.floor((F.col("ts") - s0 - window) / F.lit(step)) + 1)
    rows = read_edges_csv(spark, path).withColumn("first", first).withColumn("last", last).where("first <= last")
    rows = rows.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("start_ts", F.col("i") * step + s0)
    return rows.join(slices, "start_ts").select("t", "u", "v", "ts")


def migrate_slices(spark: SparkSession, root: str, manifest: dict, path: str) -> DataFrame:
    """One log, under `path`, of a folder of slices; refused if a slice doesn't hold as many edges as its manifest says, or an edge
    is outside its slice. Edges of several slices are taken from the first of them."""
    rows = kept(read_slices(spark, root))
    slices = spark.createDataFrame([(k, s["start_ts"], s["end_ts"], s["edge_count"]) for k, s in enumerate(manifest["slices"])], "t int, start_ts long, end_ts long, edge_count long")
    n = rows.join(slices.select("t", "start_ts", "end_ts"), "t", "left").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts"))).alias("inside"))
    wrong = slices.join(n, "t", "full").where("not (n <=> edge_count and inside <=> n)")
    if not wrong.isEmpty():
        raise ValueError(f"slices don't fit their manifest: {sorted(r.t for r in wrong.select('t').limit(20).collect())}")
    before = F.lag("end_ts").over(Window.orderBy("t"))  # one row for each slice
    new = rows.join(slices.select("t", before.alias("seen")), "t").where("seen is null or ts >= seen")
    write_edges_csv(new.withColumn("ord", F.monotonically_increasing_id()), path)
    return read_edges_csv(spark, path)


def bad_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log that aren't three integers."""
    lines = spark.read.text(path).where("value <> 'u,v,ts'")
    return lines.where(~F.col("value").rlike(r"^-?\d+,-?\d+,-?\d+$"))


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Raw records in file order as (ord, u, v, ts); ts may be fractional. Kinds: ml (u,i,ts), csv (u,v,ts), txt (u v ts, # comments), coin (day,src,dst,value)."""
    if kind == "ml":
        out = in_file_order(spark.read.csv(path, header=True)).withColumnRenamed("i", "v")
    elif kind == "csv":
        out = in_file_order(spark.read.csv(path, header=True))
    elif kind == "txt":
        out = parse_text(in_file_order(spark.read.text(path)))
    elif kind == "coin":
        raw = spark.read.csv(path, header=True)
        names = raw.columns
        raw = in_file_order(raw)
        return coin_edges(raw.select("ord", F.col(names[0]).alias("day"), F.col(names[1]).alias("src"), F.col(names[2]).alias("dst")))[0]
    else:
        raise ValueError(f"unknown format {kind}")
    return out.select("ord", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("ts").cast("decimal(38,9)").alias("ts"))


def in_file_order(rows: DataFrame) -> DataFrame:
    """`rows` with `ord`, their order by file name and place in the file, however Spark packs files into tasks."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("at")
    return dense_ids(rows.select("*", at), "at", "ord").drop("at")


def parse_text(lines: DataFrame) -> DataFrame:
    """(ord, u, v, ts) of white-space separated lines (ord, value); comments and blank lines are left out."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    ok = (F.trim("value") != "") & ~F.trim("value").startswith("#")
    return lines.where(ok).select("ord", part[0].cast("long").alias("u"), part[1].cast("long").alias("v"), part[2].cast("decimal(38,9)").alias("ts"))


def coin_edges(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and the (node_id, address) table of rows (ord, day, src, dst).

    Addresses are numbered by first appearance, a row's source before its target, before any row is
    left out. Numbers need one order over all addresses: a range sort by first place, then each
    partition's count added up, so no single task sees every address.
    """
    ends = raw.select("ord", F.posexplode(F.array("src", "dst")).alias("pos", "address"))
    if not ends.where("address is null or trim(address) = ''").isEmpty():
        raise ValueError("empty address")
    nodes = dense_ids(ends.groupBy("address").agg(F.min(F.struct("ord", "pos")).alias("at")), "at", "node_id").select("node_id", "address")
    src, dst = nodes.select(F.col("address").alias("src"), F.col("node_id").alias("u")), nodes.select(F.col("address").alias("dst"), F.col("node_id").alias("v"))
    return raw.join(src, "src").join(dst, "dst").select("ord", "u", "v", F.col("day").cast("decimal(38,9)").alias("ts")), nodes


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """`df` with numbers 0, 1, ... in `order`."""
    part = df.repartitionByRange(order).sortWithinPartitions(order)
    part = kept(part.withColumn("__part", F.spark_partition_id()).withColumn("__mono", F.monotonically_increasing_id()))
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # one row for each partition
    row = F.col("__mono") - F.shiftleft(F.col("__part").cast("long"), 33)
    return part.join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + row).cast("long")).drop("__part", "__mono", "__base")


def floor_ts(ts: Column | str) -> Column:
    """Whole seconds, rounded down also below zero."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(c.cast("decimal(38,9)")).cast("long")


def standardise(raw: DataFrame, min_ts: int | None = None) -> DataFrame:
    """(u, v, ts, ord) of raw records (ord, u, v, ts): whole seconds, no loops, none before `min_ts`, and the first record of each second and undirected pair, by time and file order."""
    rows = raw.withColumn("ts", floor_ts("ts")).where("u <> v")
    if min_ts is not None:
        rows = rows.where(F.col("ts") >= min_ts)
    first = Window.partitionBy("ts", F.least("u", "v"), F.greatest("u", "v")).orderBy("ord")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return rows.select("u", "v", "ts", "ord")


def standardise_audit(raw: DataFrame, min_ts: int | None = None) -> DataFrame:
    """One row of counts: records, loops, before_start, duplicates, fractional, descents, written."""
    start = F.lit(min_ts if min_ts is not None else -(2**62))
    ts = floor_ts("ts")
    rows = raw.select("ord", "u", "v", F.col("ts").cast("decimal(38,9)").alias("raw"), ts.alias("ts"))
    low = with_before(rows, "ts", "ord")
    n = low.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("u") == F.col("v")).alias("loops"),
        F.count_if((F.col("u") != F.col("v")) & (F.col("ts") < start)).alias("before_start"),
        F.count_if(F.col("raw") != F.col("ts")).alias("fractional"),
        F.count_if(F.col("before") > F.col("ts")).alias("descents"),
    )
    w = standardise(raw, min_ts).agg(F.count(F.lit(1)).alias("written"))
    return n.crossJoin(w).withColumn("duplicates", F.col("records") - F.col("loops") - F.col("before_start") - F.col("written"))


def with_before(df: DataFrame, value: str, order: str, chunk: int = 1_000_000) -> DataFrame:
    """`df` with `before`, the value of the row before in `order` (a long).

    Rows are looked at in chunks of the order's numbers, side by side; only a chunk's last value goes to the next.
    """
    rows = df.withColumn("__c", F.floor(F.col(order) / F.lit(chunk)))
    rows = rows.withColumn("before", F.lag(value).over(Window.partitionBy("__c").orderBy(order)))
    last = rows.groupBy("__c").agg(F.max_by(value, order).alias("__last"))
    last = last.select("__c", F.lag("__last").over(Window.orderBy("__c")).alias("__prior"))  # one row for each chunk
    return rows.join(last, "__c").withColumn("before", F.coalesce("before", "__prior")).drop("__c", "__prior")


def descents(edges: DataFrame, order: str = "ord") -> DataFrame:
    """Rows whose time is under that of the row before."""
    return with_before(edges, "ts", order).where("before > ts")


def require_sorted(edges: DataFrame, order: str = "ord") -> DataFrame:
    if not descents(edges, order).isEmpty():
        raise ValueError("the edge log isn't sorted by ts")
    return edges


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, ts, ord) of the events table: each day, one actor to the next."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"))
    # within each hour side by side; the last of an hour is followed by the first of the day's next hour with events
    order = ["ts", "event_id"]
    e = e.withColumn("next", F.lead("user_id").over(Window.partitionBy("day", "hour").orderBy(*order)))
    first = e.groupBy("day", "hour").agg(F.min_by("user_id", F.struct(*order)).alias("actor"))
    after = first.select("day", "hour", F.lead("actor").over(Window.partitionBy("day").orderBy("hour")).alias("after"))  # 24 rows of a day
    v = F.coalesce("next", "after")
    rows = e.join(after, ["day", "hour"]).select(F.col("user_id").alias("u"), v.alias("v"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("ord"))
    return rows.where("v is not null")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, ts, ord): suppliers and parts, linked when a line is shipped."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    return rows.select(F.col("l_suppkey").alias("u"), (F.lit(1_000_000_000) + F.col("l_partkey")).alias("v"), ts.alias("ts"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"))


def write_edges_csv(edges: DataFrame, path: str) -> None:
    """The log sorted by ts, then file order; an existing one is never overwritten."""
    edges.orderBy("ts", "ord").select("u", "v", "ts").write.mode("errorifexists").csv(path, header=True)


def export_events(snapshot_edges: DataFrame) -> DataFrame:
    """Snapshot edges as events at t + 1: (u, v, ts)."""
    return snapshot_edges.select("u", "v", (F.col("t") + 1).cast("long").alias("ts")).distinct()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, text: str, path: str, replace: bool = True) -> None:
    """A small text as one file, written beside its place and renamed to it: readers see the old one or the new one."""
    at, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace and fs.exists(at):
        options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        rename = spark.sparkContext._gateway.new_array(options, 1)
        rename[0] = options.OVERWRITE
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, at, rename)
    elif not fs.rename(beside, at):
        fs.delete(beside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def generations(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, name) of the published generations, the newest last."""
    at, fs = _fs(spark, f"{root}/published")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n), read_text(spark, f"{root}/published/{n}").strip()) for n in names if n.isdigit())


def publish(tables: dict[str, DataFrame], root: str, keep: int | None = None) -> str:
    """Writes a generation of tables beside the others, reads it back, and only then names it the newest.

    A generation is named by a file of its own with the next number, which appears by renaming: a reader, or a crash,
    finds the one before or the new one. If a table's rows don't come back as written, or another writer took the
    number, the generation is deleted and nothing changes. keep: only so many newest generations stay.
    """
    spark = next(iter(tables.values())).sparkSession
    generation, before = uuid.uuid4().hex, generations(spark, root)
    path = f"{root}/generations/{generation}"
    try:
        for name, df in tables.items():
            counter = Observation()
            df.observe(counter, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{name}")
            if (back := spark.read.parquet(f"{path}/{name}")).count() != counter.get["rows"] or back.columns != df.columns:
                raise OSError(f"{name} isn't as it was written")
        write_text(spark, generation, f"{root}/published/{before[-1][0] + 1 if before else 0:010d}", replace=False)
    except BaseException:
        at, fs = _fs(spark, path)
        fs.delete(at, True)
        raise
    for number, old in before[: len(before) + 1 - keep] if keep else ():
        for gone in (f"{root}/published/{number:010d}", f"{root}/generations/{old}"):
            at, fs = _fs(spark, gone)
            fs.delete(at, True)
    return generation


def roll_back(spark: SparkSession, root: str) -> str:
    """Takes the newest generation back; gives the one before, which is the newest again."""
    found = generations(spark, root)
    if len(found) < 2:
        raise ValueError("there is no generation before")
    at, fs = _fs(spark, f"{root}/published/{found[-1][0]:010d}")
    fs.delete(at, False)
    at, fs = _fs(spark, f"{root}/generations/{found[-1][1]}")
    fs.delete(at, True)
    return found[-2][1]


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = generations(spark, root)
    if not found:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/generations/{found[-1][1]}/{name}")


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    write_text(spark, json.dumps(manifest, sort_keys=True), path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest with every key it must have and at least one slice."""
    m = json.loads(read_text(spark, path))
    if missing := [k for k in MANIFEST_KEYS if k not in m]:
        raise ValueError(f"manifest lacks {missing}")
    if not m["slices"] or m["window_alignment"] != "right":
        raise ValueError("manifest has no slices or another alignment")
    return m


def source_files(edges: DataFrame) -> DataFrame:
    """(path, size, modified) of the files a table comes from, to tell whether a source has changed."""
    m = edges.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return m.distinct().toDF("path", "size", "modified")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): files of a source that are new, gone, or of another size or time than `before`, a table of source_files."""
    a, b = now.select("path", F.struct("size", "modified").alias("a")), before.select("path", F.struct("size", "modified").alias("b"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "other")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def check_mappings(nodes: DataFrame, mapping: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without a row in the (original_id, dense_id) mapping; rows of (step, slice_index) that break 1, 2, ..."""
    missing = nodes.select(F.col("node").alias("original_id")).distinct().join(mapping, "original_id", "left_anti")
    gaps = times.withColumn("before", F.lag("step", 1, 0).over(Window.orderBy("step"))).where("step <> before + 1")
    return missing, gaps
