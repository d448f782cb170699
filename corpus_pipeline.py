"""The corpus pipeline: quality rules, near duplicates, secrets, source weights, tokens.

Each stage works on all rows that the one before kept, and returns the columns of documents, the last one its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlake.llm import bpe, jaccard, mixing, rules, secrets
from counterlake.llm.store import documents, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rules keep."""
    return rules.judge(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every component the document with the smallest doc_id; documents without words stand alone."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a mark in place of each secret; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(
        *docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mixture says (not at all, once or twice)."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded text, one row per copy."""
    # executors hold the heap of the stages before, so this one takes small slices
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                  slice_bytes=2_000_000, kept=100_000)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secrets", without_secrets),
          ("mix_sources", mixed), ("byte_bpe", tokens)]
#: No SQL: the last stage's merges cannot be written in it. Tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
