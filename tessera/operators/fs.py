"""File-system reads: listings, sizes, ranges, grep, statistics, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import QuotaExceeded
from tessera.functions import paths, text
from tessera.sources import formats

GREP_MOST = 1000
FILES_CAP, LIST_CAP, GREP_CAP = 100_000, 10_000, 50_000


def files_view(dentries: DataFrame, files_meta: DataFrame) -> DataFrame:
    """The ``files`` relation: entries left-joined to their records, times as text."""
    d, m = dentries.alias("d"), files_meta.alias("m")
    when = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(f"d.{c}"))
    return d.join(m, F.col("d.file_id") == F.col("m.file_id"), "left").select(
        "d.path", "d.name", "d.file_id", "d.is_dir", "m.size_bytes", "m.mime_type", "m.revision", "m.checksum", "m.ref_count", "m.line_count", "m.storage_type", "m.source_type",
        F.when(~F.col("d.is_dir"), text.rfc3339(when("created_at"))).alias("created_at"),
        F.when(~F.col("d.is_dir"), text.rfc3339(when("updated_at"))).alias("updated_at"),
    )


def guarded(df: DataFrame, cap: int | None) -> DataFrame:
    """``df``, or an error where it has more than ``cap`` rows; never a silent cut."""
    if cap is not None and df.limit(cap + 1).count() > cap:
        raise QuotaExceeded(f"more than {cap} entries")
    return df


def list_recursive(dentries: DataFrame, sizes: DataFrame, prefix: str, cap: int | None = None) -> DataFrame:
    """Strict descendants of a directory: path, name, type, size_bytes, mtime (the entry's)."""
    inside = guarded(dentries.where(paths.strictly_under(F.col("path"), prefix)), cap)
    kind = F.when(F.col("is_dir"), "directory").otherwise("file").alias("type")
    return inside.join(sizes.select("file_id", "size_bytes"), "file_id", "left").select("path", "name", kind, "size_bytes", text.rfc3339(F.col("updated_at")).alias("mtime"))


def list_dir(dentries: DataFrame, directory: str) -> DataFrame:
    return dentries.where(F.col("parent_path") == directory).select("path", "name", "is_dir")


def children_capped(dentries: DataFrame, directory: str, n: int) -> DataFrame:
    """The first ``n`` children, directories first, then by the bytes of the path."""
    return list_dir(dentries, directory).orderBy(F.desc("is_dir"), "path").limit(n)


def keyset_page(dentries: DataFrame, prefix: str, after: str, n: int) -> DataFrame:
    """A page of the subtree after ``after``: filter and top-n, whatever the page's number."""
    inside = dentries.where(paths.strictly_under(F.col("path"), prefix) & (F.col("path") > after))
    return inside.select("path", "is_dir").orderBy("path").limit(n)


def subtree_capped(dentries: DataFrame, prefix: str, cap: int) -> DataFrame:
    return guarded(dentries.where(paths.strictly_under(F.col("path"), prefix)).select("path", "is_dir"), cap)


def _top(path: Column, prefix: str) -> Column:
    return F.substring_index(F.substr(path, F.lit(len(prefix.rstrip("/")) + 2)), "/", 1)


def count_by_top_level(dentries: DataFrame, prefix: str = "/") -> DataFrame:
    """Files by first segment below ``prefix``, whose spelling is the least of those that compare equal."""
    own = dentries.where(~F.col("is_dir") & paths.strictly_under(F.col("path"), prefix)).select(_top(F.col("path"), prefix).alias("segment"))
    counted = own.groupBy(F.collate("segment", "UNICODE_CI_AI").alias("folded")).agg(F.min("segment").alias("segment"), F.count(F.lit(1)).alias("n_files"))
    return counted.select("segment", "n_files")


def bytes_by_child(dentries: DataFrame, files_meta: DataFrame, prefix: str = "/") -> DataFrame:
    """Bytes of all files below each child; a file counts once for each of its paths."""
    own = dentries.where(~F.col("is_dir") & paths.strictly_under(F.col("path"), prefix))
    sized = own.join(files_meta.select("file_id", "size_bytes"), "file_id")
    return sized.groupBy(_top(F.col("path"), prefix).alias("child")).agg(F.sum("size_bytes").cast("long").alias("total_bytes"))


def list_dir_sizes(dentries: DataFrame, files_meta: DataFrame, directory: str) -> DataFrame:
    """Children with sizes; a directory's is that of its subtree, 0 where it has no file."""
    sums = bytes_by_child(dentries, files_meta, directory).withColumnRenamed("child", "name")
    kids = dentries.where(F.col("parent_path") == directory).select("path", "name", "is_dir")
    return kids.join(sums, "name", "left").select("path", "name", "is_dir", F.coalesce("total_bytes", F.lit(0).cast("long")).alias("size_bytes"))


def storage_stats(dentries: DataFrame, files_meta: DataFrame) -> DataFrame:
    joined = dentries.join(files_meta.select("file_id", "size_bytes"), "file_id", "left")
    return joined.agg(
        F.count_if(~F.col("is_dir")).alias("total_files"),
        F.count_if("is_dir").alias("total_directories"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"),
    )


def grep(files: DataFrame, pattern: str, prefix: str = "/", ignore_case: bool = False, limit: int = 100) -> DataFrame:
    """Lines that hold ``pattern`` as a substring, by path and line number; binary files are skipped."""
    limit = min(max(limit, 1), GREP_MOST)
    if not pattern:
        return formats.text_lines(files).where(F.lit(False)).select(F.col("_path").alias("path"), F.col("_line_number").alias("line_no"), "line")
    fold = F.lower if ignore_case else (lambda c: c)
    own = files.where(paths.under(F.col("path"), prefix) & ~text.is_binary(F.col("content")) & F.contains(fold(F.col("content")), fold(F.lit(pattern))))
    hits = formats.text_lines(own).where(F.contains(fold(F.col("line")), fold(F.lit(pattern))))
    return hits.select(F.col("_path").alias("path"), F.col("_line_number").alias("line_no"), "line").orderBy("path", "line_no").limit(limit)


def line_range(file_chunks: DataFrame, first: int, last: int) -> DataFrame:
    """Stored chunks that overlap lines ``first`` to ``last``; the last one may lack its newline."""
    start, count = F.col("start_line"), F.col("line_count")
    return file_chunks.where((start <= last) & (start + count >= first)).select("file_id", "chunk_index", "start_line", "line_count")


def byte_range(file_chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """Stored chunks that overlap a byte range, with each chunk's offset."""
    before = Window.partitionBy("file_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    placed = file_chunks.withColumn("byte_offset", F.coalesce(F.sum("byte_len").over(before), F.lit(0)).cast("long"))
    overlap = (F.col("byte_offset") < offset + length) & (F.col("byte_offset") + F.col("byte_len") > offset)
    return placed.where(overlap).select("file_id", "chunk_index", "byte_offset", "byte_len")


def lookup(queries: DataFrame, dentries: DataFrame, files_meta: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """For each query path: exists_, size_bytes, mtime and, with contents, content.

    The scalar functions of the SQL surface are this join; a null path stays null.
    """
    from_entry = dentries.select(F.col("path").alias("__path"), F.col("file_id"), "is_dir", F.col("updated_at").alias("__entry_time"))
    asked = queries.withColumn("__normal", paths.normalize_lenient(F.col("path")))
    out = asked.join(from_entry, F.col("__normal") == F.col("__path"), "left").join(files_meta.select("file_id", "size_bytes", F.col("updated_at").alias("__file_time")), "file_id", "left")
    there = F.when(F.col("path").isNull(), F.lit(None)).otherwise((F.col("__normal") == "/") | F.col("__path").isNotNull())
    columns = [*queries.columns, F.coalesce(there, F.when(F.col("path").isNotNull(), F.lit(False))).alias("exists_"), "size_bytes", text.rfc3339(F.coalesce("__file_time", "__entry_time")).alias("mtime")]
    if contents is not None:
        out = out.join(contents.select("file_id", "content"), "file_id", "left")
        columns.append("content")
    return out.select(*columns)


def index_backlog(outbox: DataFrame) -> DataFrame:
    """Counts of index tasks by type and open status."""
    own = outbox.where(F.col("event_type").isin("chunk_sync", "summary_sync") & F.col("status").isin("pending", "processing", "dead"))
    return own.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


def workspace_layout(dentries: DataFrame, files_meta: DataFrame, summaries: DataFrame, cap: int) -> DataFrame:
    """Up to ``cap`` entries of the root with file counts, sizes and abstracts; ``state`` is ready
    where all returned entries have an abstract, ``truncated`` where there were more."""
    kids = dentries.where(F.col("parent_path") == "/").select("id", "path", "name", "is_dir", "file_id")
    shown = kids.orderBy(F.desc("is_dir"), "path").limit(cap)
    counts = count_by_top_level(dentries).withColumnRenamed("segment", "name")
    sizes = bytes_by_child(dentries, files_meta).withColumnRenamed("child", "name")
    by_dir = summaries.where("dentry_id is not null").select(F.col("dentry_id").alias("id"), F.col("l0_abstract").alias("of_dir"))
    by_file = summaries.where("file_id is not null").select("file_id", F.col("l0_abstract").alias("of_file"))
    zero = F.lit(0).cast("long")
    out = shown.join(counts, "name", "left").join(sizes, "name", "left").join(by_dir, "id", "left").join(by_file, "file_id", "left")
    out = out.select("path", "is_dir", F.coalesce("n_files", zero).alias("file_count"), F.coalesce("total_bytes", zero).alias("size_bytes"), F.coalesce("of_dir", "of_file").alias("l0_abstract"))
    state = out.agg(F.coalesce(F.bool_and(F.col("l0_abstract").isNotNull()), F.lit(True)).alias("all_ready"))
    total = kids.agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return out.crossJoin(F.broadcast(state)).crossJoin(F.broadcast(total)).select(*out.columns, F.when(F.col("all_ready"), "ready").otherwise("partial").alias("state"), "truncated")
