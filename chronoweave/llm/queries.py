"""Queries of the operators in this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chains, digest, format_trees
from .common import read_table
from .decontaminate import contamination
from .html_text import extract
from .jaccard_join import near_duplicates
from .langid import fit_documents, predict
from .line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from .ogg import read_media, store_texts
from .suffix_dedup import remove_repeats
from .token_ids import read_id_files, write_id_files
from .wfst import encode_documents



def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "text", F.col("lines_in").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"))


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(read_table(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_id_files(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return read_id_files(files)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digest(format_trees(chains(rows.union(more))))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


LINE_DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(source, '') AS host, text FROM {{docs}}),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
b AS (SELECT rid, host, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
c AS (SELECT host, bare, count(DISTINCT rid) AS n FROM b WHERE bare <> '' GROUP BY 1, 2),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
f AS (SELECT c.host, c.bare FROM c JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages),
m AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (f.bare IS NOT NULL) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (f.bare IS NULL) AS kept
      FROM b LEFT JOIN f ON b.host = f.host AND b.bare = f.bare GROUP BY rid)
"""

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(9243), chr(9243) || '0'), '(\|)(>)', '\1' || chr(9243) || '1\2', 'g'),
  '(<)(/?s>|</?SYS>>|\|)', '\1' || chr(9243) || '1\2', 'g'), '(\[)(/?INST\]|/?SYS\])', '\1' || chr(9243) || '1\2', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(esc) + 10) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL: dict[str, str] = {
    "op8_chat": CHAT_SQL,
    "op7_line_dedup": LINE_DEDUP_SQL.format(docs="documents")
    + "SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN m USING (rid)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg": op1_ogg,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_ids": op6_token_ids,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat": op8_chat,
    "op9_langid": op9_langid,
    "op10_html": op10_html,
}
