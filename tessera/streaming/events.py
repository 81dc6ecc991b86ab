"""Change events and access counters as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.errors import InvalidInput, NotFound
from tessera.functions import paths
from tessera.operators import state

BATCH = 100


def event_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    """New event files of a folder; the checkpoint of the query that reads them is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def tail(events: DataFrame, prefix: str | None = None) -> DataFrame:
    """Events of a subtree, stream or batch."""
    return events if prefix is None else events.where(paths.under(F.col("path"), paths.require_path(prefix, lenient=True)))


def check_cursor(events: DataFrame, cursor: int) -> None:
    """Raises, with the bounds to start anew from, where events after ``cursor`` are gone."""
    row = state.cursor_bounds(events, cursor).first()
    if row["expired"]:
        raise NotFound(f"cursor {cursor} is older than the log: {row['min_id']} to {row['max_id']}")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on what is there now, batch by batch; a batch that failed runs again."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heat_stream(access: DataFrame, offset_h: int = state.DAY_OFFSET_H, late: str = "1 day") -> DataFrame:
    """Counters by day under a fixed offset; days older than the watermark are final.

    ``access`` has ts (timestamp), dentry_id, search_hits, read_count.
    """
    shifted = access.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL '{int(offset_h)}' HOUR")).withWatermark("ts", late)
    by = shifted.groupBy(F.window("ts", "1 day").alias("w"), "dentry_id")
    summed = by.agg(F.sum("search_hits").cast("long").alias("search_hits"), F.sum("read_count").cast("long").alias("read_count"))
    return summed.select(F.col("w.start").cast("date").alias("day"), "dentry_id", "search_hits", "read_count")


def windowed_counts(events: DataFrame, kind: str, size: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """An extra: events by type in tumbling, sliding or session windows under a watermark. A session ends
    ``size`` after its last event; an event at that very time begins another."""
    if kind not in ("tumbling", "sliding", "session"):
        raise InvalidInput(f"window: {kind!r}")
    # sessions that touch are merged, so each is short by the least step until it is counted
    window = F.session_window("ts", f"{size} -1 microseconds") if kind == "session" else F.window("ts", size, step if kind == "sliding" else None)
    by = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    end = F.expr("w.end + INTERVAL '0.000001' SECOND") if kind == "session" else F.col("w.end")
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), end.alias("end"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """An extra: each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
