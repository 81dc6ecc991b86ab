"""Text pipeline: chunking, storage chunks, watermarks, summaries and their roll-up."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.intermediate import stored

MAX_TOKENS, CHUNK_BYTES, ROLLUP_CHARS, PROMPT_CHARS, LEAD = 2048, 256 * 1024, 8000, 12_000, 120


def is_heading(line: str) -> bool:
    """One to six hashes after optional space, then a space, a tab or the end."""
    bare = line.lstrip()
    rest = bare.lstrip("#")
    return 1 <= len(bare) - len(rest) <= 6 and rest[:1] in ("", " ", "\t")


def sections(value: str) -> list[str]:
    out: list[list[str]] = [[]]
    for line in value.split("\n"):
        line = line.removesuffix("\r")
        if is_heading(line) and out[-1]:
            out.append([])
        out[-1].append(line)
    return ["\n".join(s) for s in out]


def windows(section: str, budget: int, overlap: int) -> Iterator[str]:
    """Windows of up to ``budget`` quarter tokens (1 for ASCII, 4 for others), each starting where the
    last had spent all but the overlap. Prefix sums make each cut a binary search."""
    n = len(section)
    if not n:
        return
    raw = np.frombuffer(section.encode("utf-32-le"), np.uint32)
    spent = np.concatenate([[0], np.cumsum(np.where(raw < 128, 1, 4))])
    step = budget - min(overlap, budget - 1)
    start = 0
    while True:
        end = max(int(np.searchsorted(spent, spent[start] + budget, "right")) - 1, start + 1)
        yield section[start:end]
        if end >= n:
            return
        start = min(max(int(np.searchsorted(spent, spent[start] + step, "left")), start + 1), end, n)


def semantic_chunk(value: str, max_tokens: int = MAX_TOKENS) -> list[str]:
    budget = max(max_tokens * 4, 1)
    return [w for s in sections(value) for w in windows(s, budget, max(budget // 5, 16))] if value else []


def semantic_chunks(files: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """file_id, chunk_index, content of (file_id, content); binary files have none."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            rows = [(f, k, c) for f, v in zip(pdf["file_id"], pdf["content"], strict=True) for k, c in enumerate(semantic_chunk(v or "", max_tokens))]
            yield pd.DataFrame(rows, columns=["file_id", "chunk_index", "content"])

    own = files.where(~text.is_binary(F.col("content"))).select("file_id", "content")
    return own.mapInPandas(batches, "file_id string, chunk_index int, content string")


def storage_chunk(value: str, size: int = CHUNK_BYTES) -> list[tuple[int, int, int, str, str]]:
    """(start_line, line_count, byte_len, sha256, content), each but the last ending on a newline."""
    data, out, at, line = value.encode(), [], 0, 1
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b"\n", at, end)
            cut = cut if cut >= 0 else data.find(b"\n", end)
            end = cut + 1 if cut >= 0 else len(data)
        part = data[at:end]
        out.append((line, part.count(b"\n"), len(part), hashlib.sha256(part).hexdigest(), part.decode()))
        line += part.count(b"\n")
        at = end
    return out


def storage_chunks(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """file_id, chunk_index, start_line, line_count, byte_len, chunk_sha256, content."""

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_id", "chunk_index", "start_line", "line_count", "byte_len", "chunk_sha256", "content"]
        for pdf in found:
            yield pd.DataFrame([(f, k, *c) for f, v in zip(pdf["file_id"], pdf["content"], strict=True) for k, c in enumerate(storage_chunk(v or "", size))], columns=names)

    return files.select("file_id", "content").mapInPandas(batches, "file_id string, chunk_index int, start_line int, line_count int, byte_len int, chunk_sha256 string, content string")


def embed_backlog(files_meta: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Files whose content is not the one last embedded (file_id, checksum)."""
    return files_meta.select("file_id", "checksum").join(watermarks.select("file_id", "checksum"), ["file_id", "checksum"], "left_anti")


def fresh_extract(files_meta: DataFrame, extracts: DataFrame) -> DataFrame:
    """Extracted texts that were made of the file's present content."""
    now = files_meta.select("file_id", F.col("checksum").alias("source_sha256"))
    return extracts.join(now, ["file_id", "source_sha256"]).select("file_id", "content")


def file_summaries(files: DataFrame, summarize: Callable[[str], tuple[str, str]] | None = None) -> DataFrame:
    """file_id, l0_abstract, l1_overview; without a model the text's lead."""
    short = files.select("file_id", text.truncated_middle(F.col("content"), PROMPT_CHARS).alias("content"))
    if summarize is None:
        return short.select("file_id", F.left(F.trim("content"), F.lit(120)).alias("l0_abstract"), F.left(F.trim("content"), F.lit(600)).alias("l1_overview"))

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            rows = [(f, *summarize(v)) for f, v in zip(pdf["file_id"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["file_id", "l0_abstract", "l1_overview"])

    return short.mapInPandas(batches, "file_id string, l0_abstract string, l1_overview string")


def child_summaries(dentries: DataFrame, summaries: DataFrame, directory: str) -> DataFrame:
    """path, l0_abstract of a directory's children, files' and directories' own."""
    kids = dentries.where(F.col("parent_path") == directory).select("id", "path", "file_id")
    files = kids.join(summaries.where("file_id is not null").select("file_id", "l0_abstract"), "file_id").select("path", "l0_abstract")
    dirs = kids.join(summaries.where("dentry_id is not null").select(F.col("dentry_id").alias("id"), "l0_abstract"), "id").select("path", "l0_abstract")
    return files.unionByName(dirs)


def dir_rollup(children: DataFrame, most: int = ROLLUP_CHARS) -> DataFrame:
    """parent_path, text: children's abstracts (parent_path, path, l0_abstract) numbered in path order,
    cut in the middle at ``most`` characters."""
    place = F.row_number().over(Window.partitionBy("parent_path").orderBy("path"))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]. "), F.col("l0_abstract"))
    numbered = children.withColumn("n", place).select("parent_path", F.struct("n", line.alias("line")).alias("item"))
    joined = numbered.groupBy("parent_path").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return joined.select("parent_path", text.truncated_middle(F.array_join("items.line", "\n"), most).alias("text"))


def rollup_levels(dentries: DataFrame, summaries: DataFrame, most: int = ROLLUP_CHARS) -> DataFrame:
    """parent_path, text: every directory's roll-up, deepest first, of its files and of its
    sub-directories together, in path order. A directory's abstract is its roll-up's lead; one below
    which no file has an abstract has no roll-up.

    As many rounds as the tree is deep, each written out, so that none is computed twice.
    """
    depth = F.when(F.col("parent_path") == "/", 0).otherwise(paths.depth(F.col("parent_path")))
    files = stored(child_rows(dentries, summaries).withColumn("depth", depth), "rollup-files", deepest=F.max("depth"))
    deepest = files.observed["deepest"]
    if deepest is None:
        return dir_rollup(files.drop("depth"), most)
    dirs = dentries.where("is_dir and path <> '/'").select("path", "parent_path")
    out, below = None, None
    for level in range(deepest, -1, -1):
        known = files.where(F.col("depth") == level).drop("depth")
        if below is not None:
            lead = below.select(F.col("parent_path").alias("path"), F.left("text", F.lit(LEAD)).alias("l0_abstract"))
            known = known.unionByName(dirs.join(lead, "path").select("parent_path", "path", "l0_abstract"))
        below = stored(dir_rollup(known, most), f"rollup{level}")
        out = below if out is None else out.unionByName(below)
    return out


def child_rows(dentries: DataFrame, summaries: DataFrame) -> DataFrame:
    """parent_path, path, l0_abstract of files that have one."""
    files = dentries.where(~F.col("is_dir")).select("parent_path", "path", "file_id")
    return files.join(summaries.where("file_id is not null").select("file_id", "l0_abstract"), "file_id").select("parent_path", "path", "l0_abstract")
