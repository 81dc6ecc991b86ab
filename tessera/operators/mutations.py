"""Writes as merges of DataFrames: each returns the new state, and where it matters the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import AlreadyExists, InvalidPath, NotFound
from tessera.functions import paths, text

COUNTER_KEY = ("day", "dentry_id")


def write_merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merges incoming (path, content) into current (path, file_id, checksum, revision, ref_count).

    One row per incoming path with its ``action``: ``unchanged`` (same bytes, same revision),
    ``rewrite`` (sole owner, in place), ``fork`` (shared: a new file id), ``create``; and the
    event it emits, none where nothing changed. Where incoming has an ``expected_revision`` that is not
    null, 0 for a path that must be new, and the path has another, the action is ``conflict``: the row
    tells what is there and nothing changes.
    """
    expects = "expected_revision" in incoming.columns
    new = incoming.select(F.col("path"), text.sha256(F.col("content")).alias("new_checksum"), F.octet_length("content").cast("long").alias("size_bytes"), *(["expected_revision"] if expects else []))
    both = new.join(current, "path", "left")
    clash = (F.coalesce("revision", F.lit(0)) != F.col("expected_revision")) if expects else F.lit(False)
    action = (
        F.when(clash, "conflict")
        .when(F.col("file_id").isNull(), "create")
        .when(F.col("checksum") == F.col("new_checksum"), "unchanged")
        .when(F.col("ref_count") > 1, "fork")
        .otherwise("rewrite")
    )
    moved = both.withColumn("action", action)
    as_it_was = F.col("action").isin("unchanged", "conflict")
    revision = F.when(F.col("action") == "create", F.lit(1)).when(as_it_was, F.col("revision")).otherwise(F.col("revision") + 1)
    file_id = F.when(F.col("action").isin("create", "fork"), F.concat(F.lit("n"), F.left("new_checksum", F.lit(16)))).otherwise(F.col("file_id"))
    event = F.when(F.col("action") == "create", "create").when(~as_it_was, "update")
    checksum = F.when(F.col("action") == "conflict", F.col("checksum")).otherwise(F.col("new_checksum"))
    size = F.when(F.col("action") != "conflict", F.col("size_bytes"))
    return moved.select("path", file_id.alias("file_id"), checksum.alias("checksum"), revision.cast("int").alias("revision"), size.alias("size_bytes"), "action", event.alias("event"))


def append_merge(files: DataFrame, appended: DataFrame) -> DataFrame:
    """Files (path, content) after appending (path, content); an empty append changes nothing."""
    more = appended.select("path", F.col("content").alias("more"))
    both = files.join(more, "path", "left")
    content = F.concat("content", F.coalesce("more", F.lit("")))
    changed = F.coalesce(F.length("more") > 0, F.lit(False))
    return both.select("path", text.sha256(content).alias("checksum"), F.octet_length(content).cast("long").alias("size_bytes"), text.line_count(content).alias("line_count"), changed.alias("changed"))


def copy_file(dentries: DataFrame, source: str, target: str) -> DataFrame:
    """``dentries`` with ``target`` as an alias of ``source``'s file; an overwritten target goes."""
    row = dentries.where((F.col("path") == source) & ~F.col("is_dir"))
    if row.isEmpty():
        raise NotFound(source)
    alias = row.withColumns({"path": F.lit(target), "parent_path": paths.parent(F.lit(target)), "name": paths.filename(F.lit(target)), "id": F.concat(F.lit("f"), F.lit(target))})
    return dentries.where(F.col("path") != target).unionByName(alias)


def ref_counts(dentries: DataFrame) -> DataFrame:
    """file_id, ref_count: how many paths name each file. A file that is missing here can be collected."""
    return dentries.where("file_id is not null").groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("ref_count"))


def rename_subtree(dentries: DataFrame, old: str, new: str) -> DataFrame:
    """Entries of the subtree under their new paths: old_path, path, parent_path, name, is_dir."""
    if new == old or new.startswith(old + "/"):
        raise InvalidPath("a directory cannot move into itself")
    if not dentries.where(F.col("path") == new).isEmpty():
        raise AlreadyExists(new)
    own = dentries.where(paths.under(F.col("path"), old))
    path = paths.rebased(F.col("path"), old, new)
    return own.select(F.col("path").alias("old_path"), path.alias("path"), paths.parent(path).alias("parent_path"), paths.filename(path).alias("name"), "is_dir")


def rename_events(renamed: DataFrame) -> DataFrame:
    """A delete of each old path and a move to each new one."""
    gone = renamed.select(F.lit("delete").alias("event_type"), F.col("old_path").alias("path"))
    return gone.unionByName(renamed.select(F.lit("move").alias("event_type"), "path"))


def delete_subtree(dentries: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, removed entries with itself)."""
    inside = paths.under(F.col("path"), path)
    return dentries.where(~inside), dentries.where(inside)


def appended_bytes(files: DataFrame, appended: DataFrame) -> DataFrame:
    """path, n: the bytes that ``append_merge`` adds to each file; a missing file is created with them."""
    return appended.select("path", F.octet_length("content").cast("long").alias("n"))


def removed_count(dentries: DataFrame, path: str) -> DataFrame:
    """One row, n: the entries that go with ``path``. A missing path is an error."""
    found = delete_subtree(dentries, path)[1].agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit(f"not found: {path}")).cast("long")).alias("n"))


def made_directories(wanted: DataFrame, dentries: DataFrame) -> DataFrame:
    """path, made of the directories asked for: true whether they were there or are made now; a file
    of that path is an error."""
    there = dentries.select("path", "is_dir")
    clash = F.raise_error(F.concat(F.lit("a file has this path: "), F.col("path"))).cast("boolean")
    return wanted.join(there, "path", "left").select("path", F.when(F.coalesce("is_dir", F.lit(True)), F.lit(True)).otherwise(clash).alias("made"))


def coalesced_writes(changes: DataFrame, wait_ms: int = 5000) -> DataFrame:
    """path, seq, action, content: what a client sends after waiting ``wait_ms`` from a path's last change.

    ``changes`` has path, seq, ts (timestamp), action (write or delete), content. Writes of a path
    closer than the wait are one, the last; a delete cancels the writes it follows and goes alone.
    """
    by = Window.partitionBy("path").orderBy("seq")
    gap = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(by).cast("timestamp"))
    runs = changes.withColumn("opens", F.coalesce((gap >= wait_ms).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("opens").over(by))
    last = runs.groupBy("path", "run").agg(F.max_by(F.struct("seq", "action", "content"), "seq").alias("last"))
    return last.select("path", "last.seq", "last.action", F.when(F.col("last.action") == "write", F.col("last.content")).alias("content"))


def orphaned_files(dentries: DataFrame, removed: DataFrame) -> DataFrame:
    """Files that only removed entries named."""
    return removed.where("file_id is not null").select("file_id").distinct().join(dentries.select("file_id"), "file_id", "left_anti")


def missing_ancestors(wanted: DataFrame, dentries: DataFrame) -> DataFrame:
    """Directories to make before the wanted paths can be, root first by depth."""
    up = wanted.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return up.join(dentries.select("path"), "path", "left_anti").where("path <> '/'").withColumn("depth", paths.depth(F.col("path")))


def last_wins(records: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row a key: the last row's values at the first row's position."""
    by = Window.partitionBy(key)
    kept = records.withColumn("__rn", F.row_number().over(by.orderBy(F.desc(order)))).withColumn("__first", F.min(order).over(by))
    return kept.where("__rn = 1").drop("__rn", order).withColumnRenamed("__first", order)


def upsert(current: DataFrame, records: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """``current`` with the last of each record put in its place."""
    new = last_wins(records, key, order).drop(order)
    return current.join(new.select(key), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def insert_rows(collection: DataFrame, rows: DataFrame, embed=None, source: str | None = None) -> DataFrame:
    """Rows with an id each and, with ``embed`` (a column function), a vector of ``source``, or of
    the whole row as JSON."""
    text_of = F.col(source) if source else F.to_json(F.struct(*rows.columns))
    out = rows.withColumn("id", F.uuid())
    if embed is not None:
        out = out.withColumn("vector", embed(text_of))
    return collection.unionByName(out, allowMissingColumns=True)


def vector_delete(vectors: DataFrame, requested: DataFrame) -> tuple[DataFrame, int]:
    """(rows that stay, ids requested: rows that were not there count too)."""
    return vectors.join(requested.select("pk"), "pk", "left_anti"), requested.count()


def heat_merge(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters with additions merged in."""
    both = stored.select(*COUNTER_KEY, "search_hits", "read_count").unionByName(delta.select(*COUNTER_KEY, "search_hits", "read_count"))
    return both.groupBy(*COUNTER_KEY).agg(F.sum("search_hits").cast("long").alias("search_hits"), F.sum("read_count").cast("long").alias("read_count"))


def retention_sweep(rows: DataFrame, ts: str, now: str, days: int, only_terminal: bool = False) -> DataFrame:
    """Rows that stay: younger than ``days`` or, with ``only_terminal``, not yet completed or dead."""
    young = F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")
    return rows.where(young | ~F.col("status").isin("completed", "dead")) if only_terminal else rows.where(young)
