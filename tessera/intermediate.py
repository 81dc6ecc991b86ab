"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one is made for
    sessions that run in this process alone; a cluster has no such folder, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Frames stored since each open ``scratch`` began, the innermost last.
_SCOPES: contextvars.ContextVar[tuple[list, ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is stored inside it when it ends, but for the frames given to the function that it
    yields; those belong to the scratch around it, if there is one."""
    held: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _SCOPES.set((*_SCOPES.get(), held))
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _SCOPES.reset(token)
        paths = {df.stored_at for df in kept}
        release(*[df for df in held if df.stored_at not in paths])
        if _SCOPES.get():
            _SCOPES.get()[-1].extend(df for df in held if df.stored_at in paths)


#: Removes a query's shuffle files when it ends; what ``stored`` wrote is all that is read later.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """What is planned in it has this setting of the session."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def no_shuffle_kept(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Writes in it leave no shuffle files."""
    return setting(spark, _CLEAN, "true")


def stored(df: DataFrame, name: str, at: str | None = None, compression: str = "snappy", **counts: Column) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors.

    Aggregates given by name are taken of what was written; the result has them in ``observed``.
    """
    spark = df.sparkSession
    path = at or f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with no_shuffle_kept(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    out.observed = out.agg(*[c.alias(k) for k, c in counts.items()]).first().asDict() if counts else {}
    if _SCOPES.get():
        _SCOPES.get()[-1].append(out)
    return out


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def release(*found: DataFrame) -> None:
    """Deletes the files of ``stored`` frames that nothing reads any more."""
    for df in found:
        system, path = file_system(df.sparkSession, df.stored_at)
        system.delete(path, True)
