"""The queries opN_<name>: each applies one operator, with production parameters, to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, editprint, langid, lines, mixing, quality, recompress, simhash, suffixes, webp
from .common import held_out, staged, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_words(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lined AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), each AS (
  SELECT doc_id, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM lined
), clean AS (
  SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM each
), spread AS (
  SELECT line FROM clean WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5
), kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM (SELECT *, line <> '' AND line IN (SELECT line FROM spread) AS gone FROM clean) GROUP BY doc_id
)
SELECT l.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE sha256(coalesce(k.kept, '')) END AS kept_sha256
FROM lined l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.near_counts(staged(editprint.edited_prints(table(spark, sf_dir, "documents"))))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_recompression": op3_recompression,
    "op4_simhash": op4_simhash,
    "op5_webp": op5_webp,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_mix": op8_mix,
    "op9_edit_prints": op9_edit_prints,
    "op10_suffixes": op10_suffixes,
}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL}
