"""Tables that streams are merged into: by key, once a batch, across restarts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.errors import Storage
from tessera.intermediate import file_system
from tessera.operators import snapshots

#: Parts of a table by a hash of the key; a batch rewrites those that it touches.
BUCKETS = 32


def _bucket(keys: Sequence[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def rows(spark: SparkSession, folder: str, schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table as it now is, or some of its buckets."""
    found: dict[str, list[int]] = {}
    for p in snapshots.current(spark, folder).parts:
        if buckets is None or p["bucket"] in buckets:
            found.setdefault(p["path"], []).append(p["bucket"])
    frames = [spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(own)).drop("bucket") for path, own in sorted(found.items())]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def merge(batch: DataFrame, n: int, folder: str, keys: Sequence[str]) -> None:
    """Puts the rows of batch ``n`` in place of those with their keys, of which it has one each. A batch
    that is in already is left out, so that one that runs again after a failure counts once."""
    spark = batch.sparkSession
    base = snapshots.current(spark, folder)
    if base.properties.get("batch", -1) >= n:
        return
    schema = ", ".join(f"{c} {t}" for c, t in batch.dtypes)
    marked = batch.withColumn("bucket", _bucket(keys)).persist()
    try:
        touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())  # at most BUCKETS
        parts = [p for p in base.parts if p["bucket"] not in touched]
        if touched:
            path = snapshots.new_part(folder)
            old = rows(spark, folder, schema, touched).join(batch.select(*keys), list(keys), "left_anti").withColumn("bucket", _bucket(keys))
            old.unionByName(marked).repartition("bucket").write.partitionBy("bucket").parquet(path)
            parts += [{"bucket": b, "path": path} for b in touched]
        snapshots.commit(spark, folder, base.revision, parts, {"batch": n})
    finally:
        marked.unpersist()


def merging(stream: DataFrame, folder: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Merges a stream in update mode over what is there now: a batch brings only the keys that changed."""
    put = lambda batch, n: merge(batch, n, folder, keys)
    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_merged(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """``merging`` to its end, below ``folder``; the merged table."""
    merging(stream, f"{folder}/table", keys, f"{folder}/checkpoint").awaitTermination()
    return rows(stream.sparkSession, f"{folder}/table", ", ".join(f"{c} {t}" for c, t in stream.dtypes))


def run_completed(stream: DataFrame, folder: str) -> DataFrame:
    """All groups of a stream of aggregates over what is there now and what earlier runs below ``folder`` have
    read, those that are still open too: each batch writes the whole result, the last one is read."""
    spark, table = stream.sparkSession, f"{folder}/table"

    def put(batch: DataFrame, n: int) -> None:
        path = snapshots.new_part(table)
        batch.write.parquet(path)
        snapshots.commit(spark, table, snapshots.current(spark, table).revision, [{"path": path}], {"batch": n})

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = snapshots.current(spark, table).parts
    return spark.read.schema(stream.schema).parquet(parts[0]["path"]) if parts else spark.createDataFrame([], stream.schema)


def run_appended(stream: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream in append mode over what is there now and what earlier runs below ``folder``
    have read: a table a batch, which a batch that runs again replaces."""
    spark = stream.sparkSession
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    system, path = file_system(spark, f"{folder}/rows")
    if not system.exists(path):
        return spark.createDataFrame([], stream.schema)
    there = sorted(f.getPath().getName() for f in system.listStatus(path))
    broken = [x for x in there if not system.exists(file_system(spark, f"{folder}/rows/{x}/_SUCCESS")[1])]
    if broken:
        raise Storage(f"batches that did not end: {', '.join(broken)}")
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows/{x}" for x in there])
