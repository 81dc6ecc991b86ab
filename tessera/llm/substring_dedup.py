"""Removal of repeated byte strings by bucket-pointer refinement.

A string of ``LENGTH`` bytes falls into a bucket by the q-gram at one of its positions, and a
bucket is refined by the buckets of later offsets, whose own refinement is reused: the bucket of
2q bytes at i is the pair of the buckets of q bytes at i and at i + q, and so on up to
``LENGTH``. Buckets are named by 64-bit hashes of such pairs, so that a name is the same in every
task; names of one level are only compared within one bucket of the level before.

Sorting every position would move a row per byte. Instead each window of ``LENGTH`` bytes is
filed under its least ``GRAM``-byte bucket, a choice that depends on the window's bytes alone:
windows in a row share it, equal windows have it at the same offset. So one row stands for a run
of windows. Rows alone in their bucket are done (their windows occur once), as are rows whose
whole run occurs again; what is left is refined to runs of ``RUN`` windows and then to windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, release, scratch, stored, table

LENGTH, GRAM, RUN = 400, 200, 16
#: Bytes named at once, and the length from which one text is named in parts.
CHUNK, PART = 1 << 18, 1 << 22

_A, _B, _U32, _U29 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32), np.uint64(29)
_LOW = np.uint64(0xFFFFFF)
_BYTES = np.array([((k + 1) * 0xD6E8FEB86659FD93 ^ (k + 1) * 0x2545F4914F6CDD1D >> 7) & 0xFFFFFFFFFFFFFFFF for k in range(256)], np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the pair of buckets ``a`` and ``b``."""
    x = (a * _A) ^ ((b + (a >> _U29)) * _B)
    x = (x ^ (x >> _U32)) * _A
    return x ^ (x >> _U29)


def _powers(raw: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Bucket names of every position by length 1, 2, 4, ..., each from pairs of the last."""
    names, size = {1: _BYTES[raw]}, 1
    while 2 * size <= most:
        x = names[size]
        names[2 * size] = _pair(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    return names


def _names(powers: dict[int, np.ndarray], n: int, size: int) -> np.ndarray:
    """Names of the ``size``-byte strings at every position of ``n`` bytes."""
    count = max(n - size + 1, 0)
    out, at = None, 0
    for power in sorted(powers, reverse=True):
        if size - at >= power:
            x = powers[power][at : at + count]
            out, at = x if out is None else _pair(out, x), at + power
    return out


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """Position of the least name (leftmost on ties of 40 bits) among each ``width`` in a row."""
    keys, size = (names & ~_LOW) | np.arange(len(names), dtype=np.uint64), 1
    count = len(names) - width + 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return (np.minimum(keys[:count], keys[width - size : width - size + count]) & _LOW).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def runs_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, least, first, last, bucket, name) of each run of windows with one least bucket."""
    sizes = np.array([len(x) for x in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 6
    powers = _powers(raw, length)
    grams, whole = _names(powers, n, gram), _names(powers, n, length)
    least = _least(grams, length - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(whole)]
    inside = np.arange(len(whole)) + length <= ends[text]
    change = np.ones(len(whole), bool)
    change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(whole)) - 1
    first, last = first[inside[first]], last[inside[first]]
    p = least[first]
    shape = ((last - first) * (length + 1) + (p - first)).astype(np.uint64)
    name = _pair(_pair(whole[first], whole[last]), shape)  # the two windows cover the run: it is shorter than one
    start = (ends - sizes)[text[first]]
    return text[first], p - start, first - start, last - start, _signed(grams[p]), _signed(name)


def _split(text: bytes, length: int) -> list[tuple[int, bytes]]:
    """A long text in parts that share all but the first byte of a window."""
    if len(text) <= PART:
        return [(0, text)]
    return [(at, text[at : at + PART + length - 1]) for at in range(0, len(text) - length + 1, PART)]


def _portions(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(parts, index of each part's text, its offset), about ``CHUNK`` bytes at once."""
    parts, of, off, size = [], [], [], 0
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for at, part in _split(text, length):
            parts.append(part)
            of.append(k)
            off.append(at)
            size += len(part)
            if size >= CHUNK:
                yield parts, np.array(of), np.array(off)
                parts, of, off, size = [], [], [], 0
    if parts:
        yield parts, np.array(of), np.array(off)


def _encoded(column: pa.Array) -> list[bytes]:
    return ["".encode() if x is None else x.encode("utf-8") for x in column.to_pylist()]


def _filed(length: int, gram: int) -> Callable:
    """doc_id, tkey, text -> doc_id, tkey, p, s, e, bucket, name."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for parts, of, off in _portions(_encoded(batch.column(2)), length):
                text, p, s, e, bucket, name = runs_of(parts, length, gram)
                at = pa.array(of[text])
                ints = [pa.array((x + off[text]).astype(np.int32)) for x in (p, s, e)]
                columns = [batch.column(0).take(at), batch.column(1).take(at), *ints, pa.array(bucket), pa.array(name)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "p", "s", "e", "bucket", "name"])

    return batches


def _refined(length: int) -> Callable:
    """doc_id, tkey, text, rows (bucket, p, s, e) -> runs of up to ``RUN`` windows with equal offset to p:
    doc_id, tkey, s, bucket, low, name, windows (the windows' names)."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, lists = _encoded(batch.column(2)), batch.column(3).to_pylist()
            for k, text in enumerate(texts):
                rows: list[tuple] = []
                for at, part in _split(text, length):
                    raw = np.frombuffer(part, np.uint8)
                    whole = _names(_powers(raw, length), len(raw), length)
                    for r in lists[k]:
                        if not at <= r["s"] < at + PART:
                            continue
                        # offsets d = p - i of the windows i of the row, in blocks of RUN offsets
                        for block in range((r["p"] - r["e"]) // RUN, (r["p"] - r["s"]) // RUN + 1):
                            low, high = max(r["p"] - r["e"], block * RUN), min(r["p"] - r["s"], block * RUN + RUN - 1)
                            windows = whole[r["p"] - high - at : r["p"] - low - at + 1]
                            rows.append((r["p"] - high, r["bucket"], block, low, high, windows))
                if not rows:
                    continue
                ends = _pair(np.array([x[5][0] for x in rows]), np.array([x[5][-1] for x in rows]))
                names = _pair(ends, np.array([x[3] * 1000 + x[4] for x in rows], np.uint64))
                buckets = _pair(np.array([x[1] for x in rows], np.int64).astype(np.uint64), np.array([x[2] for x in rows], np.uint64))
                n = len(rows)
                same = pa.array(np.full(n, k))
                columns = [
                    batch.column(0).take(same),
                    batch.column(1).take(same),
                    pa.array([x[0] for x in rows], pa.int32()),
                    pa.array(_signed(buckets)),
                    pa.array([x[4] for x in rows], pa.int32()),
                    pa.array(_signed(names)),
                    pa.array([_signed(x[5]) for x in rows], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "s", "bucket", "high", "name", "windows"])

    return batches


def _open(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with n, the rows equal to each; the rows to refine). Rows have bucket and name.

    To refine are the rows that stand alone in a bucket with other names, and with them one row
    for each other name of that bucket.
    """
    classes = stored(rows.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n")), f"{name}-classes")
    mixed = classes.groupBy("bucket").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("names")).where("least = 1 and names > 1")
    mixed = stored(mixed.select("bucket"), f"{name}-open")
    counted = stored(rows.join(classes, ["bucket", "name"]), f"{name}-counted")
    single = counted.where("n = 1").join(mixed, "bucket", "left_semi")
    others = counted.where("n > 1").join(mixed, "bucket", "left_semi")
    shown = others.groupBy("bucket", "name").agg(F.min(F.struct(*[c for c in rows.columns if c not in ("bucket", "name")])).alias("row"))
    shown = shown.select("bucket", "name", "row.*")
    return counted, single.select(*rows.columns).unionByName(shown.select(*rows.columns))


def repeated_windows(own: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, tkey, s, e: runs of starts of the ``length``-byte strings that also start elsewhere.

    ``own`` has doc_id, tkey and text; the first two together name a document.
    """
    filed = stored(mapped(own, _filed(length, gram), "doc_id long, tkey int, p int, s int, e int, bucket long, name long"), "filed")
    shared = stored(filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    rows = stored(filed.join(shared, "bucket", "left_semi"), "shared-rows")
    release(filed)
    counted, rest = _open(rows, "runs")
    whole = counted.where("n > 1").select("doc_id", "tkey", "s", "e")

    lists = rest.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("bucket", "p", "s", "e")).alias("rows"))
    lists = lists.hint("merge")  # alike at every size
    texts = own.join(lists, own["doc_id"].eqNullSafe(lists["doc_id"]) & (own["tkey"] == lists["tkey"])).select(own["doc_id"], own["tkey"], "text", "rows")
    # a row that is repeated whole is refined twice and meets itself: its windows do occur twice
    parts = mapped(texts, _refined(length), "doc_id long, tkey int, s int, bucket long, high int, name long, windows array<long>")
    parts = stored(parts, "parts")
    counted, rest = _open(parts, "parts")
    blocks = counted.where("n > 1").select("doc_id", "tkey", "s", (F.col("s") + F.size("windows") - 1).alias("e"))

    single = rest.select("doc_id", "tkey", "bucket", "s", "high", F.posexplode("windows").alias("k", "name"))
    single = stored(single.select("doc_id", "tkey", "bucket", (F.col("high") - F.col("k")).alias("d"), (F.col("s") + F.col("k")).alias("s"), "name"), "windows")
    twice = stored(single.groupBy("bucket", "d", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice")
    last = single.join(twice, ["bucket", "d", "name"], "left_semi").select("doc_id", "tkey", "s", F.col("s").alias("e"))
    return whole.union(blocks).union(last)


def _cut(length: int) -> Callable:
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for text, spans in zip(_encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, at, runs, removed, end = hashlib.sha256(), 0, 0, 0, -1
                for s, e in sorted((x["s"], x["e"] + length) for x in spans or ()):
                    if s > end:
                        kept.update(text[max(end, 0) : s])
                        runs += 1
                        at = s
                    if e > end:
                        removed += e - max(end, at)
                        end = e
                kept.update(text[max(end, 0) :])
                rows.append((len(text), removed, runs, kept.hexdigest()))
            columns = [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return batches


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Each UTF-8 byte covered by a ``length``-byte string that also starts anywhere else, in the
    same document or another, goes; strings are judged on the input. Null counts as empty; texts
    shorter than ``length`` keep all. Rows repeated whole are each other's repeats and both
    return. Null ids are allowed; rows that share an id are told apart by their texts. Other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    with scratch() as hold:
        spans = repeated_windows(own, length, gram).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        spans = hold(stored(spans, "spans"))
    spans = spans.hint("merge")
    joined = own.join(spans, own["doc_id"].eqNullSafe(spans["doc_id"]) & (own["tkey"] == spans["tkey"]), "left").select(own["doc_id"], "text", "spans")
    return mapped(joined, _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
b AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT doc_id, s, hash(substr(x, 2 * s + 1, 800)) AS g FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS s FROM b WHERE n >= 400)),
r AS (SELECT doc_id, s FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
o AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r),
i AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM o),
p AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS z FROM i GROUP BY doc_id, run),
q AS (SELECT p.doc_id, p.run, a, z, coalesce(lag(z) OVER (PARTITION BY p.doc_id ORDER BY a), 0) AS last FROM p),
k AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS z FROM q GROUP BY doc_id),
t AS (SELECT q.doc_id, string_agg(substr(b.x, 2 * q.last + 1, 2 * (q.a - q.last)), '' ORDER BY q.a) AS head FROM q JOIN b ON b.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t.head, '') || substr(b.x, 2 * coalesce(k.z, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k ON b.doc_id = k.doc_id LEFT JOIN t ON b.doc_id = t.doc_id
"""
