"""Files stored by path: a subtree is a range of paths, and only the files that it is in are opened.

Rows are dealt to files by ranges of the path and sorted by it. A table beside them has each file's first and
last path, from which a scan of a subtree knows its files; within these the readers skip row groups and pages
by their own bounds, as the subtree is a comparison and not a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import NotFound
from tessera.functions import paths
from tessera.operators import snapshots

#: Rows of a file, about.
FILE_ROWS = 500_000
#: Files that a scan names; for more it reads all and leaves the rest to the bounds of the files.
NAMED = 10_000


def bounds(prefix: str) -> tuple[str, str]:
    """Paths below ``prefix`` are those from the first on and before the second: ``0`` follows the slash."""
    return prefix.rstrip("/") + "/", prefix.rstrip("/") + "0"


def inside(path: Column, prefix: str) -> Column:
    """The subtree as a comparison of bytes, which readers push down; ``prefix`` itself is not below."""
    low, high = bounds(prefix)
    return (path >= low) & (path < high)


def build(files: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> snapshots.Snapshot:
    """Writes ``files`` (path and others) as the next revision of the table at ``folder``."""
    spark = files.sparkSession
    base = snapshots.current(spark, folder)
    path = snapshots.new_part(folder)
    parts = max(1, -(-files.count() // file_rows))
    files.repartitionByRange(parts, "path").sortWithinPartitions("path").write.parquet(f"{path}/rows")
    whole = spark.read.schema(files.schema).parquet(f"{path}/rows")
    stats = whole.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count(F.lit(1)).alias("n"))
    stats.repartitionByRange(1, "first").sortWithinPartitions("first").write.parquet(f"{path}/files")
    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return snapshots.commit(spark, folder, base.revision, [{"path": path}], {"schema": schema})


def scan(spark: SparkSession, folder: str, prefix: str = "/") -> DataFrame:
    """The rows below ``prefix``, from the files that hold some."""
    found = snapshots.current(spark, folder)
    if not found.revision:
        raise NotFound(folder)
    path, schema = found.parts[0]["path"], found.properties["schema"]
    reader = spark.read.schema(schema)
    prefix = paths.require_path(prefix, lenient=True)
    if prefix == "/":
        return reader.parquet(f"{path}/rows")
    low, high = bounds(prefix)
    held = spark.read.parquet(f"{path}/files").where((F.col("last") >= low) & (F.col("first") < high))
    names = [r["file"] for r in held.select("file").limit(NAMED + 1).collect()]
    rows = reader.parquet(f"{path}/rows") if len(names) > NAMED else reader.parquet(*[f"{path}/rows/{n}" for n in names]) if names else spark.createDataFrame([], schema)
    return rows.where(inside(F.col("path"), prefix))
