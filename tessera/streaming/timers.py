"""Leases as state with timers in event time, debounced directories as session windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import state

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """A task's lease: when it ends, if one is held, and how often one ran out. State is read and written
    once a batch of rows, for each call to it is a round trip."""

    def __init__(self, lease_ms: int, most: int):
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "until long, lost int")

    def _expired(self, key, until: int, n: int) -> Row:
        return Row(task_id=key[0], expired_ms=until, retries=n, status="dead" if n >= self.most else "pending")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, lost = self.lease.get() or (None, 0)
        until = held
        for ms, done in sorted((r["ms"], r["done"]) for r in rows):  # a batch is held for one task only
            if until is not None and ms >= until:
                lost += 1
                yield self._expired(key, until, lost)
            until = None if done else ms + self.lease_ms
        self.lease.update((until, lost))
        if until != held:
            if held is not None:
                self.handle.deleteTimer(held)
            if until is not None:
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, lost = self.lease.get() or (None, 0)
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.update((None, lost + 1))
            yield self._expired(key, until, lost + 1)

    def close(self) -> None:
        pass


def leases(signs: DataFrame, lease_s: int = state.LEASE_S, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """task_id, expired_ms, retries, status: one row each time a lease runs out.

    ``signs`` has task_id (string), ts (timestamp) and done: a claim or a heartbeat, or the end. A lease lasts
    ``lease_s`` from the last sign; one at that very time comes too late. A task that lost ``most``
    leases is dead. State is two numbers a task.
    """
    signs.sparkSession.conf.set(PROVIDER, ROCKS)  # the only store that has timers
    timed = signs.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("task_id").transformWithState(Leases(lease_s * 1000, most), "task_id string, expired_ms long, retries int, status string", "Append", "EventTime")


def debounced(changes: DataFrame, wait_s: int = state.DEBOUNCE_WAIT_S, late: str = "10 minutes") -> DataFrame:
    """directory, n, due_ms: a row for each run of changes of a directory (directory, ts), once the watermark
    says that none came for ``wait_s``; a change at that very time begins another run. State is a session
    window for each run that is not over."""
    timed = changes.withColumn("ts", F.date_trunc("MILLISECOND", "ts")).withWatermark("ts", late)
    # windows that touch are merged, so each is short of the wait by the least step
    by = timed.groupBy(F.session_window("ts", f"{wait_s} seconds -1 microseconds").alias("w"), "directory")
    return by.agg(F.count(F.lit(1)).alias("n")).select("directory", "n", F.expr("(unix_micros(w.end) + 1) div 1000").alias("due_ms"))
