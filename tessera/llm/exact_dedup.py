"""Exact dedup: local combining, salted digest groups, then a global merge of salt winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import ASCII_SPACE, stored, table, unused

SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE + "+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Stages: Spark's partial aggregation on (salt, digest, text) dedups within each task; the
    first shuffle merges those by digest and salt, so a text that holds a third of all rows
    never meets in one task as rows; the second merges one winner per salt. Text is part of
    every grouping key, so each stage compares full contents, not digests alone.

    Nulls and empty texts are one group. A null id is never preferred over another id; it stays
    only where a group has no other. Rows that repeat both id and text count in ``group_size``
    and each return. Columns other than the two named are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("check"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "check", "salt", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = (
        salted.groupBy("digest", "check", "norm")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("digest", "check", "keep_id", "group_size")
    )
    return (
        rows.select("doc_id", "digest", "check")
        .join(groups, ["digest", "check"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whose names are free. Of rows that repeat both id
    and text one stays, whichever, though other columns differ; of null ids with one text one row stays,
    where no other id has it."""
    id_, digest, own = (unused(docs, x) for x in ("__id", "__digest", "__own"))
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest))
    keep = stored(keep, "kept")
    marked = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest))
    return marked.join(keep.hint("merge"), same, "left_semi").dropDuplicates([id_col, own]).select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
