"""A stored table of file chunks that grows at its end.

An append reads the last chunk of each file and no other, cuts it anew with what is appended, and adds
the rows as a part of the next revision together with the keys that they replace; only these chunks
are hashed. Chunks before the last end on a line end and never change.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QuotaExceeded
from tessera.operators import snapshots
from tessera.operators.pipeline import CHUNK_BYTES, storage_chunk

KEY = ["file_id", "chunk_index"]
SCHEMA = "file_id string, chunk_index int, start_line int, line_count int, byte_len int, chunk_sha256 string, content string"
FILE_BYTES = 50 << 20
#: Replaced chunks that are broadcast; parts from which on the table is written anew.
BROADCAST_ROWS, MERGE_PARTS = 500_000, 16


def _read(spark: SparkSession, snapshot: snapshots.Snapshot) -> DataFrame:
    if not snapshot.parts:
        return spark.createDataFrame([], SCHEMA)
    parts = [spark.read.schema(SCHEMA).parquet(f"{p['path']}/rows").withColumn("seq", F.lit(p["seq"])) for p in snapshot.parts]
    rows = reduce(DataFrame.unionByName, parts)
    count = sum(p["replaced"] for p in snapshot.parts)
    if count:
        gone = [spark.read.schema("file_id string, chunk_index int").parquet(f"{p['path']}/replaced").withColumn("by", F.lit(p["seq"])) for p in snapshot.parts if p["replaced"]]
        newest = reduce(DataFrame.unionByName, gone).groupBy(*KEY).agg(F.max("by").alias("by"))
        newest = F.broadcast(newest) if count <= BROADCAST_ROWS else newest
        rows = rows.join(newest, KEY, "left").where(F.col("by").isNull() | (F.col("seq") >= F.col("by"))).drop("by")
    return rows.drop("seq")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks as they now are."""
    return _read(spark, snapshots.current(spark, folder))


def tails(stored: DataFrame, appended: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The chunks that ``appended`` (file_id, content; a file once) makes of each file's last one, which is
    read alone; of a file without chunks, its first ones. Empty appends give none."""
    more = appended.where(F.octet_length("content") > 0).select("file_id", F.col("content").alias("more"))
    last = stored.select(*KEY).join(more.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.max("chunk_index").alias("chunk_index"))
    tail = stored.select(*KEY, "start_line", "content").join(last, KEY)
    both = more.join(tail, "file_id", "left").select("file_id", F.coalesce("chunk_index", F.lit(0)).alias("at"), F.coalesce("start_line", F.lit(1)).alias("line"), F.concat(F.coalesce("content", F.lit("")), F.col("more")).alias("content"))

    def cut(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in found:
            rows = [(r.file_id, r.at + k, r.line + line - 1, n, size_, sha, text) for r in pdf.itertuples() for k, (line, n, size_, sha, text) in enumerate(storage_chunk(r.content, size))]
            yield pd.DataFrame(rows, columns=names)

    return both.mapInPandas(cut, SCHEMA)


def append(folder: str, appended: DataFrame, size: int = CHUNK_BYTES, most: int = FILE_BYTES) -> snapshots.Snapshot:
    """Commits ``appended`` to the stored chunks. Raises ``QuotaExceeded`` where a file would be over
    ``most`` bytes, and then nothing is written; two writers at once come one after the other."""
    spark = appended.sparkSession

    def change(base: snapshots.Snapshot):
        now = _read(spark, base)
        more = appended.where(F.octet_length("content") > 0).select("file_id", F.octet_length("content").cast("long").alias("n"))
        held = now.select("file_id", F.col("byte_len").cast("long").alias("n")).join(more.select("file_id"), "file_id", "left_semi")
        most_bytes = held.unionByName(more).groupBy("file_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if most_bytes is None:
            return None
        if most_bytes > most:
            raise QuotaExceeded(f"a file of {most_bytes} bytes")
        path, seq = snapshots.new_part(folder), base.properties.get("next", 0)
        tails(now, appended, size).sortWithinPartitions(*KEY).write.parquet(f"{path}/rows")
        rows = spark.read.schema(SCHEMA).parquet(f"{path}/rows")
        first = rows.groupBy("file_id").agg(F.min("chunk_index").alias("chunk_index"))
        first.join(now.select(*KEY), KEY, "left_semi").select(*KEY).write.parquet(f"{path}/replaced")
        count = spark.read.parquet(f"{path}/replaced").count()
        return [*base.parts, {"path": path, "seq": seq, "replaced": count}], {"next": seq + 1}

    made = snapshots.committed(spark, folder, change)
    return compacted(spark, folder) if len(made.parts) > MERGE_PARTS else made


def compacted(spark: SparkSession, folder: str) -> snapshots.Snapshot:
    """All live chunks as one part."""

    def change(base: snapshots.Snapshot):
        path, seq = snapshots.new_part(folder), base.properties.get("next", 0)
        _read(spark, base).repartition("file_id").sortWithinPartitions(*KEY).write.parquet(f"{path}/rows")
        return [{"path": path, "seq": seq, "replaced": 0}], {"next": seq + 1}

    return snapshots.committed(spark, folder, change)


def contents(rows: DataFrame) -> DataFrame:
    """file_id, content, size_bytes, line_count put together from chunks; a file's chunks are bounded by
    ``FILE_BYTES``."""
    whole = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"), F.sum("byte_len").cast("long").alias("size_bytes"), F.sum("line_count").cast("int").alias("newlines"))
    return whole.select("file_id", F.array_join("c.content", "").alias("content"), "size_bytes", "newlines")
