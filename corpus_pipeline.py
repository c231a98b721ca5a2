"""The training-data pipeline: quality rules, near-dedup, secret redaction, mixing, tokens.

STAGES lists (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorday.llm import bpe, mixing, quality_rules, secret_scan, simhash
from priorday.llm.common import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality_rules.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced in its text and n_chars brought in line."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at rates raked to the source, language and topic targets; where a rate exceeds one, in several copies."""
    return mixing.sampled(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (32-bit little-endian) of every document."""
    return bpe.encoded(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("raked_mixing", mix_sources),
    ("bpe_tokens", encode_tokens),
]

#: SQL cannot express suffix arrays, XXH64 fingerprints, zstandard novelty or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's table is written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
