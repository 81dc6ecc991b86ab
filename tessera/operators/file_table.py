"""A stored table of files with commits that expect what they were based on.

The table is versioned (``snapshots``): a write merges into the buckets that its paths are in, and becomes
the next revision in whole. A path may name the revision that the writer has seen; if it is another now,
the write is refused. Between two writers at once the second is merged into the first one's result,
and refused only where both changed a path that it had an expectation of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Conflict, InvalidInput
from tessera.operators import snapshots
from tessera.operators.mutations import write_merge

BUCKETS = 64
SCHEMA = "path string, file_id string, checksum string, revision int, size_bytes long"


def _bucket():
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, snapshot: snapshots.Snapshot, buckets: list[int] | None = None) -> DataFrame:
    found: dict[str, list[int]] = {}
    for p in snapshot.parts:
        if buckets is None or p["bucket"] in buckets:
            found.setdefault(p["path"], []).append(p["bucket"])
    frames = [spark.read.schema(f"{SCHEMA}, bucket int").parquet(path).where(F.col("bucket").isin(own)) for path, own in sorted(found.items())]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], f"{SCHEMA}, bucket int")


def files(spark: SparkSession, folder: str, revision: int | None = None) -> DataFrame:
    """Files as they are now, or were at a revision of the table that is still kept."""
    snapshot = snapshots.current(spark, folder) if revision is None else snapshots.at(spark, folder, revision)
    return _read(spark, snapshot).drop("bucket")


def write(folder: str, incoming: DataFrame, attempts: int = 5) -> snapshots.Snapshot:
    """Commits incoming (path, content and, where wanted, expected_revision: 0 for a path that must be new,
    null for any). Each path comes once. Raises ``Conflict`` where a path has another revision, and then
    nothing is written; equal content changes no revision."""
    spark = incoming.sparkSession
    rows = incoming.withColumn("bucket", _bucket()).persist()
    try:
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths")).collect()  # at most BUCKETS
        if any(r["n"] != r["paths"] for r in counts):
            raise InvalidInput("a path comes twice, or is null")
        touched = sorted(r["bucket"] for r in counts)

        def change(base: snapshots.Snapshot):
            if not touched:
                return None
            own = _read(spark, base, touched)
            shared = _read(spark, base).groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("ref_count"))
            state = own.join(rows.select("path"), "path", "left_semi").join(shared, "file_id").drop("bucket", "size_bytes")
            merged = write_merge(state, rows.drop("bucket")).persist()
            try:
                clash = merged.where("action = 'conflict'").orderBy("path").limit(5).collect()
                if clash:
                    raise Conflict("; ".join(f"{r['path']} has revision {r['revision']}" for r in clash))
                if merged.where("action <> 'unchanged'").isEmpty():
                    return None
                path = snapshots.new_part(folder)
                kept = own.join(rows.select("path"), "path", "left_anti")
                fresh = merged.select("path", "file_id", "checksum", "revision", "size_bytes").withColumn("bucket", _bucket())
                kept.unionByName(fresh).repartition("bucket").write.partitionBy("bucket").parquet(path)
            finally:
                merged.unpersist()
            return [*[p for p in base.parts if p["bucket"] not in touched], *[{"bucket": b, "path": path} for b in touched]], {}

        return snapshots.committed(spark, folder, change, attempts)
    finally:
        rows.unpersist()
