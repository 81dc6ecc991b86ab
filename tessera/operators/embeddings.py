"""Embeddings through a provider, and a stored dictionary of those made lately.

A provider takes a list of texts and gives a vector each, in order. Tasks call it in batches, again after a
growing wait where it fails. The dictionary is a versioned table by (model, text): entries expire, and the
most recently used stay within a bound, whatever the number of texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.functions import text as text_of
from tessera.intermediate import scratch, stored
from tessera.operators import snapshots
from tessera.operators.vectors import CACHED_BYTES, hashing_embedder

Provider = Callable[[list[str]], list[list[float]]]
BATCH, ATTEMPTS, WAIT_S, MOST_WAIT_S = 10, 4, 0.5, 8.0
#: Entries kept, hours from an entry's making and from its last use.
ENTRIES, TTL_H, IDLE_H = 50_000, 24, 1
SCHEMA = "cache_key string, vector array<float>, made_at timestamp_ntz, used_at timestamp_ntz"


def hashing_provider(texts: list[str]) -> list[list[float]]:
    """Offline: the words of each text, hashed."""
    own = hashing_embedder()
    return [own(t) for t in texts]


def called(provider: Provider, texts: list[str], attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> list[list[float]]:
    """One batch; the last failure is raised. An answer of another length is a failure too."""
    for left in reversed(range(attempts)):
        try:
            found = provider(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception:
            if not left:
                raise
            time.sleep(min(wait_s * 2 ** (attempts - 1 - left), MOST_WAIT_S))
    raise InvalidInput("no attempts")


def embedded(texts: DataFrame, provider: Provider = hashing_provider, batch: int = BATCH, attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> DataFrame:
    """texts (with a column ``text``) and their ``vector``, in batches of one task's rows; null has none."""
    at = texts.columns.index("text")

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            values, vectors = pdf.iloc[:, at].tolist(), [None] * len(pdf)
            wanted = [k for k, v in enumerate(values) if v is not None]
            for a in range(0, len(wanted), batch):
                some = wanted[a : a + batch]
                for k, v in zip(some, called(provider, [values[k] for k in some], attempts, wait_s), strict=True):
                    vectors[k] = v
            yield pdf.assign(vector=vectors)

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)
    return texts.mapInPandas(batches, f"{schema}, vector array<float>")


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """cache_key, vector, made_at, used_at as they were stored."""
    parts = snapshots.current(spark, folder).parts
    return spark.read.schema(SCHEMA).parquet(*[p["path"] for p in parts]) if parts else spark.createDataFrame([], SCHEMA)


def _latest(rows: DataFrame, entries: int) -> DataFrame:
    """The ``entries`` last used, then last made, then of the least keys: a limit would send them all through
    one task. Times and the beginnings of keys, which are digests, are counted and their sums give the cut."""
    age = [F.desc("used_at"), F.desc("made_at"), F.col("start")]
    started = rows.withColumn("start", F.substring("cache_key", 1, 3))
    by = ["used_at", "made_at", "start"]
    sums = started.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("past", F.sum("n").over(Window.orderBy(*age)))
    first = sums.where(F.col("past") > entries).orderBy(*age).first()  # a row for 4,096 beginnings of each pair of times
    if first is None:
        return rows
    at = [F.lit(str(first[c])).cast(t) for c, t in started.select(*by).dtypes]
    u, m, k = (F.col(c) for c in by)
    before = (u > at[0]) | ((u == at[0]) & ((m > at[1]) | ((m == at[1]) & (k < at[2]))))
    same = started.where((u == at[0]) & (m == at[1]) & (k == at[2])).orderBy("cache_key").limit(entries - (first["past"] - first["n"]))
    return started.where(before).unionByName(same).drop("start")


def cached(texts: DataFrame, folder: str, now: str, model: str, provider: Provider = hashing_provider, entries: int = ENTRIES, ttl_h: float = TTL_H, idle_h: float = IDLE_H, batch: int = BATCH) -> DataFrame:
    """``texts`` (a column text, others stay) with ``vector`` and ``hit``; the dictionary at ``folder`` is
    brought up to ``now``. Each different text is embedded once. Texts are trimmed and composed first; empty
    ones have no vector; those over ``CACHED_BYTES`` as given are embedded and not kept."""
    spark = texts.sparkSession
    moment = F.lit(now).cast("timestamp_ntz")
    hours = lambda h: F.expr(f"INTERVAL '{int(h * 3600)}' SECOND")
    own = text_of.composed(text_of.trimmed(F.col("text")))
    key = F.when(own != "", F.sha2(F.concat(F.lit(model + ":"), own), 256))
    rows = texts.select("*", key.alias("cache_key"), own.alias("own_text"), (F.octet_length("text") <= CACHED_BYTES).alias("short"))
    with scratch() as keep:
        rows = keep(stored(rows, "embed-rows"))
        base = dictionary(spark, folder)
        live = base.where((F.col("made_at") > moment - hours(ttl_h)) & (F.col("used_at") > moment - hours(idle_h)))
        wanted = rows.where("cache_key IS NOT NULL").groupBy("cache_key").agg(F.min("own_text").alias("text"), F.max("short").alias("short"))
        made = stored(embedded(wanted.join(live.select("cache_key"), "cache_key", "left_anti"), provider, batch), "embed-made")
        used = live.join(wanted.select("cache_key", F.lit(True).alias("again")), "cache_key", "left")
        hits = used.select("cache_key", "vector", "made_at", F.when(F.col("again"), moment).otherwise(F.col("used_at")).alias("used_at"))
        fresh = made.where("short").select("cache_key", "vector", moment.alias("made_at"), moment.alias("used_at"))
        all_ = keep(stored(live.join(wanted, "cache_key", "left_semi").select("cache_key", "vector", F.lit(True).alias("hit")).unionByName(made.select("cache_key", "vector", F.lit(False).alias("hit"))), "embed-vectors"))

        def change(found: snapshots.Snapshot):
            path = snapshots.new_part(folder)
            _latest(hits.unionByName(fresh), entries).write.parquet(path)
            return [{"path": path}], {"now": now}

        snapshots.committed(spark, folder, change)
    return rows.join(all_, "cache_key", "left").select(*[rows[c] for c in texts.columns], "vector", F.coalesce("hit", F.lit(False)).alias("hit"))
