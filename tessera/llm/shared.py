"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.intermediate import release, scratch, shared_dir, stored

__all__ = ["release", "scratch", "shared_dir", "stored"]

#: ``[\x20\x09-\x0D]``, the white space of every text contract here.
ASCII_SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, unless the session sets its own: texts of any length, bounded memory.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def mapped(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` over batches bounded by bytes, not only by rows."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(f, schema)


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``size`` bytes of a text column, so that no more is Python
    objects at once; at least one, and one row where a text is longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small, else left to shuffled joins."""
    return F.broadcast(df) if at_most(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)
