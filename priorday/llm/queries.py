"""Registered queries of the training-data operators: name -> f(spark, sf_dir) -> DataFrame.

Each applies one operator with its production parameters to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import repetition_rules
from .simhash import near_duplicates
from . import bpe, chat_format, filter_audit, hilbert_ann, html_text, mixing, nbsvm, secret_scan, substring_dedup, suffix_dedup, token_align


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_nearest_url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op4_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encoded(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mixed(_table(spark, sf_dir, "documents"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"),
        "source",
        "lang",
        "topic",
        F.col("tokens").alias("n_tokens"),
        F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"),
        F.round("probability", 6).alias("probability"),
        "copies",
        "sampled",
    )


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("n_spans", "kept_text")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignments(_table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.formatted(chat_format.with_probe(_table(spark, sf_dir, "conversations"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_nearest_url_text": op3_nearest_url_text,
    "op4_bpe_prefix_dp": op4_bpe_prefix_dp,
    "op5_raked_mixing": op5_raked_mixing,
    "op6_hilbert_ann": op6_hilbert_ann,
    "op7_nbsvm_quality": op7_nbsvm_quality,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_chat_format": op12_chat_format,
    "op13_filter_audit": op13_filter_audit,
}

SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM words)
), firsts AS (
  SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k
  FROM windows JOIN firsts USING (s) WHERE first_doc < doc_id
), places AS (
  SELECT doc_id, k, ws[k] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM words)
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<)(\\*/?s>)|(\[)(\\*/?INST\])', '\1\3\\\2\4', 'g') AS role_out,
    regexp_replace(text, '(<)(\\*/?s>)|(\[)(\\*/?INST\])', '\1\3\\\2\4', 'g') AS text_out
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(text_out) + CASE WHEN role = 'assistant' THEN 4 ELSE 14 + length(role_out) END) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_rewrites, CAST(0 AS BIGINT) AS n_altered
FROM written GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op5_raked_mixing": mixing.mixing_sql(), "op9_substring_dedup": SUBSTRING_SQL, "op12_chat_format": CHAT_SQL, "op13_filter_audit": filter_audit.AUDIT_SQL}
