"""Ranking: dense, BM25 and hybrid top-k, scopes, filters, summaries and aliases.

Ranks break ties by id on scores rounded to nine places, so that the order does not depend on
how sums were split over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.functions import paths, text
from tessera.operators.text_index import TextIndex, bucket

RRF_K = 60
MODES = ("hybrid", "semantic", "fulltext")
DEFAULT_LIMIT, LIMIT = 10, 100
TOP_LIMIT = 16_383


def clamp(limit: int, most: int = LIMIT) -> int:
    if limit < 0:
        raise InvalidInput("limit is negative")
    return min(limit or DEFAULT_LIMIT, most)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine to a literal vector, in doubles. The dot product is one flat expression, which
    whole-stage code generation takes; a zero or null vector has none."""
    norm = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(own > 0, dot / own)


def top(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best by score, ties by key: one bounded heap a task, no full sort."""
    return scored.where(F.col(score).isNotNull()).orderBy(F.desc(F.round(score, 9)), key).limit(min(max(k, 1), TOP_LIMIT))


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int, key: str = "id") -> DataFrame:
    return top(vectors.withColumn("score", cosine(F.col("vector"), query)), k, key=key).withColumn("score_type", F.lit("cosine"))


def query_terms(query: str, tokeniser: str = "words") -> list[str]:
    return sorted(set(text.tokens_of(query, tokeniser)))


def bm25(docs: DataFrame | None, query: str, key: str = "id", content: str = "content", index: TextIndex | None = None, scope: DataFrame | None = None, tokeniser: str = "words") -> DataFrame:
    """key, score of documents with a query term, by the stored ``index`` (within ``scope``, if
    given) or, without one, by a pass over the texts that keeps the query's terms only."""
    if index is not None:
        return index.scores(query_terms(query, index.tokeniser), scope).withColumnRenamed("id", key)
    terms = query_terms(query, tokeniser)
    words = docs.select(F.col(key).alias("id"), F.coalesce(text.tokens(F.col(content), tokeniser), F.array().cast("array<string>")).alias("w"))
    dl = F.size("w").alias("dl")
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))
    held = words.select("id", dl, F.explode(F.filter("w", lambda x: x.isin(terms) if terms else F.lit(False))).alias("term"))
    each = held.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return TextIndex(each.withColumn("bucket", bucket(F.col("term"))), words.select("id", dl), stats).scores(terms).withColumnRenamed("id", key)


def bm25_topk(docs: DataFrame | None, query: str, k: int, key: str = "id", content: str = "content", index: TextIndex | None = None, scope: DataFrame | None = None, tokeniser: str = "words") -> DataFrame:
    """The k best; over a whole stored index only blocks that can hold one of them are read."""
    if index is not None and scope is None:
        found = index.topk(query_terms(query, index.tokeniser), k).withColumnRenamed("id", key)
    else:
        found = bm25(docs, query, key, content, index, scope, tokeniser)
    return top(found, k, key=key).withColumn("score_type", F.lit("bm25"))


def ranked(best: DataFrame, key: str = "id") -> DataFrame:
    """key, rank of a top-k: the window sees k rows only."""
    by = Window.orderBy(F.desc(F.round("score", 9)), key)
    return best.select(key, "score").withColumn("rank", F.row_number().over(by)).select(key, "rank")


def fuse(rankings: Sequence[DataFrame], limit: int, key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) frames: key, score, rank."""
    parts = rankings[0].select(key, (1.0 / (k + F.col("rank"))).alias("part"))
    for r in rankings[1:]:
        parts = parts.unionByName(r.select(key, (1.0 / (k + F.col("rank"))).alias("part")))
    summed = parts.groupBy(key).agg(F.sum("part").alias("score"))
    return top(summed, limit, key=key).withColumn("score_type", F.lit("rrf"))


def search(docs: DataFrame, query: str, vector: Sequence[float] | None, mode: str = "hybrid", limit: int = DEFAULT_LIMIT, overfetch: int = 1, key: str = "id", content: str = "content", index: TextIndex | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Top documents by mode; docs have key and, as the mode needs them, content and ``vector``.

    A limit of 0 stands for ``DEFAULT_LIMIT`` and none is over ``LIMIT``. Hybrid fuses the two best
    lists of ``limit * overfetch`` each. A semantic or hybrid search without a vector is an error,
    not a quiet fulltext search. With a stored ``index`` no text is read; ``scope`` (id) names the
    documents of it that count, those of ``docs``.
    """
    return fused(docs, query, vector, mode, clamp(limit), overfetch, key, content, index, scope)


def fused(docs: DataFrame, query: str, vector: Sequence[float] | None, mode: str, limit: int, overfetch: int = 1, key: str = "id", content: str = "content", index: TextIndex | None = None, scope: DataFrame | None = None) -> DataFrame:
    """``search`` with a limit that is taken as it is."""
    if mode not in MODES:
        raise InvalidInput(f"mode: {mode!r}")
    if mode != "fulltext" and vector is None:
        raise InvalidInput(f"{mode} search needs a vector")
    k = min(limit * max(overfetch, 1), TOP_LIMIT)
    if mode == "semantic":
        return vector_topk(docs.select(key, "vector"), vector, limit, key).select(key, "score", "score_type")
    texts = None if index is not None else docs.select(key, content)
    if mode == "fulltext":
        return bm25_topk(texts, query, limit, key, content, index, scope)
    dense = ranked(vector_topk(docs.select(key, "vector"), vector, k, key), key)
    sparse = ranked(bm25_topk(texts, query, k, key, content, index, scope), key)
    return fuse([dense, sparse], limit, key)


def ranked_hits(docs: DataFrame, query: str, vector: Sequence[float] | None, mode: str, limit: int, overfetch: int, index: TextIndex | None = None, scope: DataFrame | None = None) -> DataFrame:
    """id, score, rank of the best ``limit``."""
    hits = fused(docs, query, vector, mode, limit, overfetch, index=index, scope=scope)
    return hits.join(ranked(hits), "id").select("id", "score", "rank")


def in_scope(docs: DataFrame, dentries: DataFrame, prefix: str | None) -> DataFrame:
    """Documents (file_id) that some path below ``prefix`` names: a semi-join before ranking, however
    many they are. The root and none are no scope."""
    if prefix is None:
        return docs
    prefix = paths.require_path(prefix, lenient=True)
    if prefix == "/":
        return docs
    inside = dentries.where(~F.col("is_dir") & paths.under(F.col("path"), prefix)).select("file_id")
    return docs.join(inside, "file_id", "left_semi")


def alias_resolve(hits: DataFrame, dentries: DataFrame) -> DataFrame:
    """Hits (file_id) with the smallest path of the file; ids that are no file's are looked up as entries."""
    by_file = dentries.where("file_id is not null").groupBy("file_id").agg(F.min("path").alias("__file_path"))
    by_entry = dentries.select(F.col("id").alias("file_id"), F.col("path").alias("__entry_path"))
    out = hits.join(by_file, "file_id", "left").join(by_entry, "file_id", "left")
    return out.withColumn("path", F.coalesce("__file_path", "__entry_path")).drop("__file_path", "__entry_path")


def summary_topk(vectors: DataFrame, vector: Sequence[float] | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Best summaries (id of a file or entry, vector) by cosine; there is no other ranker for them, so
    that a search without a vector is an error."""
    if vector is None:
        raise InvalidInput("summary search needs a vector")
    return vector_topk(vectors.select("id", "vector"), vector, clamp(limit)).select("id", "score", "score_type")


def detailed(docs: DataFrame, summaries: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float] | None, level: str = "full", mode: str = "hybrid", limit: int = DEFAULT_LIMIT, index: TextIndex | None = None) -> DataFrame:
    """Hits at a level of detail: ``full`` are texts by ``mode``; ``abstract`` are summaries with their
    l0_abstract, whatever the mode; ``overview`` adds their l1_overview."""
    if level == "full":
        return search(docs, query, vector, mode, limit, index=index)
    if level not in ("abstract", "overview"):
        raise InvalidInput(f"detail level: {level!r}")
    hits = with_text(summary_topk(vectors, vector, limit), summaries, "l0_abstract")
    return with_overview(hits, summaries) if level == "overview" else hits


def with_text(hits: DataFrame, summaries: DataFrame, column: str) -> DataFrame:
    """Summary hits (id of a file or entry) with ``column`` by file first, then by entry."""
    by_file = summaries.where("file_id is not null").select(F.col("file_id").alias("id"), F.col(column).alias("__f"))
    by_entry = summaries.where("dentry_id is not null").select(F.col("dentry_id").alias("id"), F.col(column).alias("__d"))
    out = hits.join(by_file, "id", "left").join(by_entry, "id", "left")
    return out.withColumn(column, F.coalesce("__f", "__d")).drop("__f", "__d")


def with_overview(hits: DataFrame, summaries: DataFrame) -> DataFrame:
    return with_text(hits, summaries, "l1_overview")


def with_min_score(hits: DataFrame, least: float | None, mode: str) -> DataFrame:
    """Hits of at least ``least``, after top-k, so that fewer than k may stay."""
    if least is None:
        return hits
    if mode == "hybrid" or not math.isfinite(least):
        raise InvalidInput("min_score: finite, and not for hybrid")
    return hits.where(F.col("score") >= least)


def impressions(hits: DataFrame) -> DataFrame:
    """query_id, dentry_id: each entry once a query; unresolved ids and directories are not counted."""
    return hits.where("dentry_id is not null and not is_dir").select("query_id", "dentry_id").dropDuplicates()
