"""The corpus pipeline: raw documents to token ids.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``.

Null texts are in no language and go at the first stage, as do texts without a letter; null languages and
sources play no part. Of rows that repeat id and text one stays at the second; rows that repeat an id with
other texts are judged by their own texts. Rows without an id are kept where their texts are. An empty
table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, language_id, near_dup, piece_codec
from tessera.intermediate import release, scratch, stored
from tessera.llm.shared import table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without a letter) go."""
    return language_id.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the one with the smallest id stays."""
    return exact_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at similarity 0.8 of five-word shingles the smallest id stays."""
    return near_dup.kept_documents(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_passages),
    ("sentencepiece", token_ids),
]

#: Language identification and SentencePiece have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:  # what the stage stored on its way goes
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        if last is not None:
            release(last)
        last = docs
    return docs
