"""Raw vector sets: filtered hybrid search, point lookups, names, embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidInput, QuotaExceeded
from tessera.functions import text as text_of
from tessera.functions.records import checked_projection, compile_filter
from tessera.operators import retrieval
from tessera.operators.text_index import TextIndex

TOP_K, OVERFETCH, IDS = 100, 5, 500
EMBED_DIM = 64
CACHED_BYTES = 4096


def scoped(vectors: DataFrame, dataset: str | None, spec: dict | None) -> DataFrame:
    """Active rows of a dataset that pass the metadata filter."""
    out = vectors.where(F.col("status") == "active")
    if dataset is not None:
        out = out.where(F.col("dataset") == dataset)
    condition = compile_filter(spec, F.col("meta"))
    return out if condition is None else out.where(condition)


def search(vectors: DataFrame, query: str, vector: Sequence[float] | None, dataset: str | None = None, mode: str = "hybrid", top_k: int = 10, min_score: float | None = None, spec: dict | None = None, output_fields: Sequence[str] | None = (), index: TextIndex | None = None) -> DataFrame:
    """Top rows of both rankers over the same filtered rows; rankers over-fetch five times top_k.

    With an ``index`` of the texts by pk, ``vectors`` needs no text; ids are ranked and output
    fields joined last."""
    if top_k == 0:
        raise InvalidInput("top_k is 0")
    if top_k > TOP_K:
        raise QuotaExceeded(f"top_k over {TOP_K}")
    fields = checked_projection(output_fields)
    rows = scoped(vectors, dataset, spec)
    own = rows.withColumn("id", F.col("pk"))
    hits = retrieval.fused(own, query, vector, mode, top_k, OVERFETCH, content="text", index=index, scope=None if index is None else own.select("id"))
    hits = retrieval.with_min_score(hits, min_score, mode)
    return hits.join(rows.select(F.col("pk").alias("id"), *[f for f in fields if f in rows.columns]), "id")


def query_ids(vectors: DataFrame, pks: Sequence[str], output_fields: Sequence[str] | None = ()) -> DataFrame:
    """Rows by key; keys that are not there are silently absent."""
    if len(pks) > IDS:
        raise QuotaExceeded(f"over {IDS} ids")
    fields = checked_projection(output_fields)
    return vectors.where((F.col("status") == "active") & F.col("pk").isin(list(pks))).select("pk", *[f for f in fields if f in vectors.columns])


def canonical_dataset(datasets: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name) with the stored spelling of the dataset it names in any case."""
    stored = datasets.select("dataset").distinct()
    return wanted.join(stored, F.collate("name", "UTF8_LCASE") == F.collate("dataset", "UTF8_LCASE"), "left").select("name", F.col("dataset").alias("canonical"))


def vector_count(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("status") == "active").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def hashing_embedder(dim: int = EMBED_DIM) -> Callable[[str], list[float]]:
    """A deterministic offline embedder: signed hashed words, unit length."""

    def embed(value: str) -> list[float]:
        out = [0.0] * dim
        for word in value.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % dim] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out

    return embed


def embedding_column(embedder: Callable[[str], list[float]] | None = None, dim: int = EMBED_DIM):
    """A column function text -> array<float>, in Arrow batches; each distinct text of a batch once."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        own = embedder or hashing_embedder(dim)
        known = {t: own(t) for t in texts.dropna().unique()}
        return texts.map(lambda t: known.get(t))

    return embed


def embed_dictionary(texts: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """cache_key, text of distinct texts, trimmed and composed, that the dictionary (cache_key) lacks;
    texts over ``CACHED_BYTES`` as given are not kept in it."""
    short = texts.where(F.octet_length("text") <= CACHED_BYTES).select(text_of.trimmed(F.col("text")).alias("text"))
    # what is empty when composed was so before; a filter after it would compose each text twice
    trimmed = short.where("text <> ''").select(text_of.composed(F.col("text")).alias("text")).distinct()
    keyed = trimmed.select(F.sha2(F.concat(F.lit(model + ":"), F.col("text")), 256).alias("cache_key"), "text")
    return keyed.join(known.select("cache_key"), "cache_key", "left_anti")
