"""Readers of stored files: lines, JSON lines, CSV and TSV, globs and listings.

They take a relation of (path, content) and return rows with ``_path`` and ``_line_number``, so
that one pass reads any number of files.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidInput, InvalidPath, NotFound, QuotaExceeded
from tessera.functions import paths, text
from tessera.sources import word

#: Bytes of one file, and of all files of one read.
FILE_BYTES, READ_BYTES = 50 * 1024 * 1024, 100 * 1024 * 1024
SAMPLE_RECORDS = 100


def text_lines(files: DataFrame) -> DataFrame:
    """_line_number (physical, from 1), line, _path."""
    each = files.select(F.col("path").alias("_path"), F.posexplode(text.lines(F.col("content"))).alias("at", "line"))
    return each.select((F.col("at") + 1).cast("long").alias("_line_number"), "line", "_path")


def jsonl_lines(files: DataFrame) -> DataFrame:
    """Trimmed lines that are valid JSON, with their physical numbers; blank and invalid ones are skipped."""
    trimmed = text_lines(files).withColumn("line", text.trimmed(F.col("line")))
    return trimmed.where((F.col("line") != "") & F.try_parse_json("line").isNotNull())


def csv_header(files: DataFrame, delimiter: str) -> tuple[list[str], list[str]]:
    """(names, types) from the header of the first file and up to ``SAMPLE_RECORDS`` lines of records. A
    quoted name may hold line ends; a record that the sample cuts off is left out."""
    first = files.orderBy("path").select(text.lines(F.col("content")).alias("lines")).limit(1)
    row = first.select(F.slice("lines", 1, SAMPLE_RECORDS + 1)).first()
    if row is None or not row[0]:
        return [], []
    sample = list(row[0])
    while len(sample) > 1 and "\n".join(sample).count('"') % 2:
        sample.pop()
    names, *records = csv.reader(io.StringIO("\n".join(sample), newline=""), delimiter=delimiter)
    types = ["long"] * len(names)
    order = ["long", "double", "boolean", "string"]
    for k in range(len(names)):
        cells = [c[k] for c in records if len(c) > k and c[k] != ""]
        types[k] = next(t for t in order if all(_fits(x, t) for x in cells)) if cells else "string"
    return names, types


def _fits(cell: str, kind: str) -> bool:
    try:
        if kind == "long":
            return str(int(cell)) == cell.lstrip("+") and abs(int(cell)) < 2**63
        if kind == "double":
            float(cell)
            return True
        return kind == "string" or cell.lower() in ("true", "false")
    except ValueError:
        return False


def csv_rows(files: DataFrame, delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """_line_number (1.. over data rows), the columns, _path. Types are inferred where no schema is given.

    A record goes on over lines while a quote is open, so a quoted field may hold line ends."""
    if schema is None:
        names, types = csv_header(files, delimiter)
        if not names:
            raise InvalidInput("no header")
        schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
    by = Window.partitionBy("_path").orderBy("_line_number")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    opens = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 0
    lines = text_lines(files).withColumn("opens", opens)
    lines = lines.withColumn("record", F.sum(F.col("opens").cast("long")).over(by))
    joined = lines.groupBy("_path", "record").agg(F.array_sort(F.collect_list(F.struct("_line_number", "line"))).alias("parts"))
    rows = joined.select("_path", "record", F.array_join("parts.line", "\n").alias("line")).where("record > 1 and line <> ''")
    number = F.row_number().over(Window.partitionBy("_path").orderBy("record"))
    options = {"sep": delimiter, "mode": "PERMISSIVE", "multiLine": "true", "escape": '"'}
    parsed = rows.select(number.cast("long").alias("_line_number"), F.from_csv("line", schema, options).alias("r"), "_path")
    return parsed.select("_line_number", "r.*", "_path")


def check_budget(files: DataFrame, file_bytes: int = FILE_BYTES, read_bytes: int = READ_BYTES) -> None:
    """Raises where a file or all files are over the budget."""
    size = F.octet_length("content")
    row = files.agg(F.max(size).alias("most"), F.sum(size).alias("total")).first()
    if (row["most"] or 0) > file_bytes or (row["total"] or 0) > read_bytes:
        raise QuotaExceeded(f"{row['most']} bytes in a file, {row['total']} in all")


def read_glob(files: DataFrame, pattern: str, budget: bool = False) -> DataFrame:
    """All files that fit ``pattern``, in their one format; an empty relation where none does."""
    found = files.where(paths.glob(F.col("path"), pattern))
    kinds = [r[0] for r in found.select(paths.detect_format(F.col("path")).alias("f")).distinct().limit(3).collect()]
    if len(kinds) > 1:
        raise InvalidInput(f"mixed formats: {', '.join(sorted(kinds))}")
    if budget:
        check_budget(found)
    return read_as(found, kinds[0] if kinds else "text")


def read_as(files: DataFrame, kind: str) -> DataFrame:
    if kind in ("csv", "tsv"):
        return csv_rows(files, "\t" if kind == "tsv" else ",")
    return jsonl_lines(files) if kind == "jsonl" else text_lines(files)


def read_path(dentries: DataFrame, contents: DataFrame, path: str) -> DataFrame:
    """The table function over paths: a glob, a directory (final slash) or one file.

    ``dentries`` as in the fixtures; ``contents`` has file_id and content.
    """
    from tessera.operators import fs

    files = dentries.where(~F.col("is_dir")).join(contents, "file_id").select("path", "content")
    if "*" in path or "?" in path:
        return read_glob(files, path)
    normal = paths.require_path(path, lenient=True)
    here = dentries.where(F.col("path") == normal).select("is_dir").first()
    if path.endswith("/"):
        if normal != "/" and here is None:
            raise NotFound(path)
        if here is not None and not here["is_dir"]:
            raise InvalidPath(f"{normal} is a file")
        return fs.list_recursive(dentries, contents.select("file_id", F.octet_length("content").cast("long").alias("size_bytes")), normal)
    if here is None:
        raise NotFound(normal)
    if here["is_dir"]:
        raise InvalidPath(f"{normal} is a directory")
    one = files.where(F.col("path") == normal)
    kind = one.select(paths.detect_format(F.col("path"))).first()[0]
    return read_as(one, kind)


def extracted_text(binaries: DataFrame, extractors: dict | None = None) -> DataFrame:
    """path, content of documents (path, content binary) by ``word.EXTRACTORS`` and pluggable ones,
    mime type to function of bytes; files of other types, and broken ones, have a null content."""
    extractors = {**word.EXTRACTORS, **(extractors or {})}
    kinds = text.mime_type(F.col("content"))

    def one(mime: str, data: bytes) -> str | None:
        try:
            return extractors[mime](data) if mime in extractors else None
        except InvalidInput:
            return None

    @F.pandas_udf("string")
    def extract(mime: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([one(m, d) for m, d in zip(mime, data, strict=True)])

    return binaries.select("path", extract(kinds, F.col("content")).alias("content"))
