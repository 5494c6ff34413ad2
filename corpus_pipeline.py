"""A corpus through five stages: language ID, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.common import read_table, written
from chronoweave.llm.decontaminate import drop_contaminated
from chronoweave.llm.jaccard_join import keep_first_of_class
from chronoweave.llm.langid import fit_documents, predict
from chronoweave.llm.line_dedup import drop_boilerplate
from chronoweave.llm.wfst import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language's posterior is under this; with four languages a text that tells nothing has 0.25.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and letterless texts go. Learns from the labels of its input."""
    out = predict(docs.select(*COLUMNS), fit_documents(docs, public_tokenizers.path("piece_bpe_32k.model")), names=("__lang", "__score"))
    return out.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sites' boilerplate lines; n_chars is counted anew, and a document with no line left goes."""
    out = drop_boilerplate(docs.select(*COLUMNS))
    out = out.where((F.col("lines_dropped") < F.col("lines_in")) | (F.col("lines_dropped") == 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return keep_first_of_class(docs.select(*COLUMNS))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids and what tells whether they decode to its text."""
    return encode_documents(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmarks", benchmarks),
    ("encoded", encoded),
]

#: Language ID, near copies by MinHash and shortest paths have no SQL; tests/llm/test_pipeline.py checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, name) if k + 1 < len(STAGES) else out
    return docs
