"""A stored text index of segments: blocks of postings with the best score they can give, delete marks,
merges, and a watermark of what it has seen.

A segment holds documents in blocks of ``BLOCK``. Of a term in a block there are its documents,
and the largest frequency and the least length among them, from which the best possible score follows
at any state of the corpus; a stored row is a term in a stretch of blocks, their lists end to end, so that a
task sorts far fewer rows than there are terms in blocks. A query for k documents scores the most promising blocks, takes the k-th score
as a floor, and reads of all other blocks only those that could beat it. Postings name a document by its
place in the block; ids, which may be long, stand once a document, and are joined to scores. A task packs
the blocks it reads and files them, and postings are neither shuffled nor, in tasks of ``SPLIT``, spilled; a block
that a task's split cuts has two rows for a term, which changes no score and loosens its bound.

A changed or deleted document is marked dead in the segment that holds it; its terms are counted once
then, so that document frequencies stay exact without reading postings. Writes are commits to a
versioned table (``snapshots``): a reader keeps its revision, of two writers at once one is refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.functions import text
from tessera.intermediate import no_shuffle_kept, release, scratch, setting, stored
from tessera.operators import snapshots
from tessera.operators.text_index import B, K1, bucket, bucket_of, weight

#: Documents of a block; segments from which on they are merged, and the share of dead documents.
BLOCK = 256
MERGE_SEGMENTS, MERGE_DEAD = 8, 0.3
#: Blocks that give the floor; surviving blocks that are named in the plan, above that they are joined.
SEED_BLOCKS, NAMED_BLOCKS = 8, 2_000
#: Of what is stored; an index of another format is another folder.
FORMAT = 4
#: Bytes of stored documents that a task packs, and of a group of their rows, which is not cut; what it sorts is some ten times that.
SPLIT = 26 << 20
#: Words from which on a stretch of blocks is packed.
STRETCH = 1_000_000
#: A document's place in its index.
PLACE = ["seq", "block", "at"]
#: Dead documents that are broadcast; more are joined by shuffles.
BROADCAST_DEAD = 200_000


@dataclass(frozen=True)
class SegmentIndex:
    """One revision of a stored index; usable wherever a ``TextIndex`` is."""

    spark: SparkSession
    folder: str
    snapshot: snapshots.Snapshot

    @property
    def tokeniser(self) -> str:
        return self.snapshot.properties["tokeniser"]

    @property
    def watermark(self) -> str | None:
        return self.snapshot.properties.get("watermark")

    @property
    def segments(self) -> list[dict]:
        return [p for p in self.snapshot.parts if p["kind"] == "segment"]

    @property
    def marks(self) -> list[dict]:
        return [p for p in self.snapshot.parts if p["kind"] == "dead"]

    @property
    def n(self) -> int:
        return sum(p["n"] for p in self.segments) - sum(p["n"] for p in self.marks)

    @property
    def avgdl(self) -> float:
        return (sum(p["words"] for p in self.segments) - sum(p["words"] for p in self.marks)) / max(self.n, 1)

    def _union(self, parts: Sequence[dict], sub: str, empty: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], empty)
        frames = [self.spark.read.schema(self._schema(sub)).parquet(f"{p['path']}/{sub}").withColumn("seq", F.lit(p["seq"])) for p in parts]
        return reduce(DataFrame.unionByName, frames)

    def _schema(self, sub: str) -> str:
        kind, keep = self.snapshot.properties["id"], "".join(f", {c} {t}" for c, t in self.snapshot.properties["keep"])
        return {
            "documents": f"id {kind}, hash string, block long, at smallint, dl int, w string{keep}",
            "postings": f"{PACKED}, bucket int",
            "dead": "block long, at smallint, of int",
            "dead_terms": "term string, n long, bucket int",
        }[sub]

    @cached_property
    def dead(self) -> DataFrame | None:
        """seq, block, at of documents that are no more in their segment; broadcast by their known number."""
        if not self.marks:
            return None
        rows = self._union(self.marks, "dead", "").select(F.col("of").alias("seq"), "block", "at")
        return F.broadcast(rows) if sum(p["n"] for p in self.marks) <= BROADCAST_DEAD else rows

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows if self.dead is None else rows.join(self.dead, PLACE, "left_anti")

    @property
    def documents(self) -> DataFrame:
        """Live documents: id, hash, dl, words, segment and what was kept."""
        return self._live(self._union(self.segments, "documents", self._schema("documents") + ", seq int")).withColumn("w", _list("w"))

    @property
    def places(self) -> DataFrame:
        """``lengths`` with seq, block, at: documents chosen of it are a scope whose ids need not be looked up."""
        return self.documents.drop("hash", "w")

    @property
    def lengths(self) -> DataFrame:
        return self.places.drop(*PLACE)

    @property
    def names(self) -> DataFrame:
        """seq, block, at, id of live documents."""
        return self.documents.select(*PLACE, "id")

    @property
    def stats(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.n).cast("long").alias("n"), F.lit(float(self.avgdl)).alias("avgdl"))

    @property
    def blocks(self) -> DataFrame:
        """term, seq, block, bucket, n, max_tf, min_dl, ats, tfs, dls: a row a term in a block, cut from the stored lists."""
        each = self._union(self.segments, "postings", self._schema("postings") + ", seq int").select("*", F.posexplode("blocks").alias("nth", "block"))
        own, n = lambda c: F.get(c, F.col("nth")), F.get("ns", F.col("nth"))
        first = F.aggregate(F.slice("ns", 1, F.col("nth")), F.lit(1), lambda s, x: s + x)
        return each.select("term", "seq", "block", "bucket", n.alias("n"), own("most").alias("max_tf"), own("least").alias("min_dl"), *[F.slice(c, first, n).alias(c) for c in ("ats", "tfs", "dls")])

    def _opened(self, rows: DataFrame) -> DataFrame:
        """term, seq, block, at, tf, dl of live documents."""
        each = rows.select("term", "seq", "block", F.explode(F.arrays_zip("ats", "tfs", "dls")).alias("p"))
        return self._live(each.select("term", *PLACE[:2], F.col("p.ats").alias("at"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")))

    def _of(self, rows: DataFrame, terms: Sequence[str]) -> DataFrame:
        return rows.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(list(terms)))

    def scores(self, terms: Sequence[str], scope: DataFrame | None = None) -> DataFrame:
        """id, score of all documents with one of ``terms``; see ``TextIndex.scores``. A scope of rows of
        this index's ``places`` is taken as it is; of any other its id counts."""
        found, names, stats = self._opened(self._of(self.blocks, sorted(set(terms)))), self.names, self.stats
        if scope is not None:
            own = scope if {*PLACE, "dl"} <= set(scope.columns) else self.places.join(scope.select("id"), "id", "left_semi")
            names, stats = own.select(*PLACE, "id"), own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
            found = found.join(names, PLACE)  # ids come along: one shuffle by place
        # a row a term, and one of statistics
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
        if scope is not None:
            return known.groupBy(*PLACE, "id").agg(F.sum(weight()).alias("score")).select("id", "score")
        return known.groupBy(*PLACE).agg(F.sum(weight()).alias("score")).join(names, PLACE).select("id", "score")

    def frequencies(self, terms: Sequence[str]) -> dict[str, int]:
        """Live documents of each term that has one: a row a term comes to the driver."""
        if not terms or not self.segments:
            return {}
        own = self._of(self.blocks, terms).groupBy("term").agg(F.sum("n").alias("n"))
        if self.marks:
            gone = self._of(self._union(self.marks, "dead_terms", ""), terms).select("term", (-F.col("n")).alias("n"))
            own = own.unionByName(gone).groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in own.collect() if r["n"] > 0}

    def bounds(self, df: dict[str, int]) -> DataFrame:
        """seq, block, best: what a document of the block can score at most. Reads no postings."""
        tf = F.col("max_tf")
        part = self._idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("min_dl") / self.avgdl))
        return self._of(self.blocks, sorted(df)).groupBy("seq", "block").agg(F.sum(part).alias("best"))

    def _idf(self, df: dict[str, int]):
        pairs = [x for t, d in sorted(df.items()) for x in (F.lit(t), F.lit(math.log(1 + (self.n - d + 0.5) / (d + 0.5))))]
        return F.element_at(F.create_map(*pairs), F.col("term"))

    def _scored(self, rows: DataFrame, df: dict[str, int]) -> DataFrame:
        """seq, block, at, score."""
        tf = F.col("tf")
        part = self._idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / self.avgdl))
        return self._opened(rows).groupBy(*PLACE).agg(F.sum(part).alias("score"))

    def candidates(self, terms: Sequence[str], k: int) -> tuple[DataFrame, dict[str, int]]:
        """(rows of postings that can hold one of the k best, frequencies)."""
        rows, df, _ = self._candidates(terms, k)
        return rows, df

    def _candidates(self, terms: Sequence[str], k: int) -> tuple[DataFrame, dict[str, int], Callable[[DataFrame], DataFrame]]:
        """``candidates`` and what keeps the rows (seq, block) of their blocks."""
        df = self.frequencies(sorted(set(terms)))
        rows = self._of(self.blocks, sorted(df))
        if not df:
            return rows, df, lambda x: x
        bounds = self.bounds(df)
        seed = bounds.orderBy(F.desc("best"), "seq", "block").limit(max(SEED_BLOCKS, -(-2 * k // BLOCK))).collect()
        named = lambda found: reduce(lambda a, b: a | b, [(F.col("seq") == s) & F.col("block").isin(sorted(r["block"] for r in found if r["seq"] == s)) for s in sorted({r["seq"] for r in found})], F.lit(False))
        floor = self._scored(rows.where(named(seed)), df).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if floor["n"] < k:
            return rows, df, lambda x: x
        alive = bounds.where(F.col("best") >= floor["least"] - 1e-8).select("seq", "block")
        few = alive.limit(NAMED_BLOCKS + 1).collect()
        kept = lambda x: x.where(named(few)) if len(few) <= NAMED_BLOCKS else x.join(alive, ["seq", "block"], "left_semi")
        return kept(rows), df, kept

    def topk(self, terms: Sequence[str], k: int) -> DataFrame:
        """id, score of documents, among them the ``k`` best of the whole index."""
        rows, df, kept = self._candidates(terms, k)
        return self._scored(rows, df).join(kept(self.names), PLACE).select("id", "score") if df else self.scores([])


def opened(spark: SparkSession, folder: str) -> SegmentIndex | None:
    """The last revision, or none where nothing was built."""
    found = snapshots.current(spark, folder)
    return SegmentIndex(spark, folder, found) if found.revision else None


def _list(w: str) -> Column:
    """Stored words as an array. They are stored in one string, spaces between, which a word has none of: that is a fifth
    smaller than a list of strings."""
    return F.when(F.col(w) == "", F.array().cast("array<string>")).otherwise(F.split(w, " "))


#: A row of postings as a task packs it: a term in a stretch of blocks, of each its number of documents, largest
#: frequency and least length, and the documents of all one after another.
PACKED = "term string, blocks array<long>, ns array<int>, most array<int>, least array<int>, ats array<smallint>, tfs array<int>, dls array<int>"


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)


def _packed(found: pa.Table) -> pa.RecordBatch:
    """Whole blocks of documents (block, at, dl, w), in order, as rows of ``PACKED``."""
    w = found.column("w").combine_chunks()
    words = w.flatten().dictionary_encode()
    block, at, dl = (found.column(c).to_numpy() for c in ("block", "at", "dl"))
    of = np.repeat(np.arange(len(w)), w.value_lengths().to_numpy())
    names, nth = np.unique(block, return_inverse=True)
    wide = int(at.max(initial=0)) + 1
    key, tf = np.unique((words.indices.to_numpy().astype(np.int64) * len(names) + nth[of]) * wide + at[of], return_counts=True)
    row = key // wide
    start = _begins(row)  # of a term's documents in a block
    term, own = row[start] // len(names), row[start] % len(names)
    first = _begins(term)  # of a term's blocks
    length = np.zeros((len(names), wide), np.int32)
    length[nth, at] = dl
    dls, tf = length[row % len(names), key % wide], tf.astype(np.int32)
    most, least = (np.maximum.reduceat(tf, start), np.minimum.reduceat(dls, start)) if len(row) else (tf, dls)
    lists = lambda begin, end, x: pa.ListArray.from_arrays(pa.array(np.r_[begin, end].astype(np.int32)), pa.array(x))
    of_blocks = [names[own], np.diff(np.r_[start, len(row)]).astype(np.int32), most, least]
    of_documents = [(key % wide).astype(np.int16), tf, dls]
    columns = [words.dictionary.take(pa.array(term[first])), *[lists(first, len(start), x) for x in of_blocks], *[lists(start[first], len(row), x) for x in of_documents]]
    return pa.RecordBatch.from_arrays(columns, names=["term", "blocks", "ns", "most", "least", "ats", "tfs", "dls"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of whole blocks, each of ``STRETCH`` words and at most a block's more; the last of what was read waits for more."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held, n = [*held, b], n + len(b.column("w").flatten())
        if n < STRETCH:
            continue
        rows = pa.Table.from_batches(held)
        starts = _begins(rows.column("block").to_numpy())
        before = np.r_[0, np.cumsum(pc.list_value_length(rows.column("w")).to_numpy())][starts]
        cuts = starts[_begins(before // STRETCH)]
        for a, z in zip(cuts, cuts[1:]):
            yield _packed(rows.slice(a, z - a))
        held, n = rows.slice(cuts[-1]).to_batches(), n - before[starts == cuts[-1]][0]
    if held:
        yield _packed(pa.Table.from_batches(held))


def _segment(words: DataFrame, folder: str, seq: int) -> dict | None:
    """Writes documents (id, hash, dl, w and kept columns) as a segment; none where there are none."""
    path = snapshots.new_part(folder)
    # a block is BLOCK documents that follow one another in one partition
    numbered = words.withColumn("place", F.monotonically_increasing_id())
    placed = numbered.withColumn("block", F.shiftright("place", BLOCK.bit_length() - 1)).withColumn("at", F.col("place").bitwiseAND(BLOCK - 1).cast("smallint"))
    with no_shuffle_kept(words.sparkSession):
        placed.drop("place").withColumn("w", F.array_join("w", " ")).write.option("compression", "zstd").option("parquet.block.size", SPLIT).parquet(f"{path}/documents")
    rows = words.sparkSession.read.parquet(f"{path}/documents")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    packed = rows.select("block", "at", "dl", _list("w").alias("w")).mapInArrow(_pack, PACKED).withColumn("bucket", bucket(F.col("term")))
    # each task files its own blocks: a file a bucket and task, and no shuffle
    with setting(words.sparkSession, "spark.sql.files.maxPartitionBytes", str(SPLIT)):
        packed.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    return {"kind": "segment", "path": path, "seq": seq, "n": n, "words": total} if n else None


def _worded(docs: DataFrame, key: str, content: str, keep: Sequence[str], tokeniser: str) -> DataFrame:
    w = F.coalesce(text.tokens(F.col(content), tokeniser), F.array().cast("array<string>"))
    body = docs.select(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("hash"), w.alias("w"), *keep)
    return body.select("id", "hash", F.size("w").alias("dl"), "w", *keep)


def _marked(index: SegmentIndex, ids: DataFrame) -> dict | None:
    """Writes marks of the live documents with one of ``ids`` (id) and the counts of their terms."""
    path = snapshots.new_part(index.folder)
    with scratch():
        gone = stored(index.documents.select("id", *PLACE, "dl", "w").join(ids, "id", "left_semi"), "dead-documents")
        n, words = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return None
        gone.select("block", "at", F.col("seq").alias("of")).write.parquet(f"{path}/dead")
        counts = gone.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("bucket", bucket(F.col("term"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/dead_terms")
    return {"kind": "dead", "path": path, "seq": 0, "n": n, "words": words}


def update(spark: SparkSession, folder: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, watermark: str | None = None, key: str = "id", content: str = "content", keep: Sequence[str] = (), tokeniser: str = "words") -> SegmentIndex:
    """The next revision: ``upserts`` (key, content, kept columns) new or instead of older ones, without
    ``deletes`` (key). Only what changes is read and written. Ids are unique within ``upserts``; one that
    is in both is an upsert. Raises ``Conflict`` where another writer was faster."""
    base = snapshots.current(spark, folder)
    parts, seq = list(base.parts), base.properties.get("next", 0)
    properties = dict(base.properties)
    if not base.revision:
        if upserts is None:
            raise InvalidInput("an empty index has no types; begin with upserts")
        types = dict(upserts.dtypes)
        properties |= {"tokeniser": tokeniser, "version": text.TOKENISERS[tokeniser][2], "id": types[key], "keep": [[c, types[c]] for c in keep]}
    elif (properties["tokeniser"], [c for c, _ in properties["keep"]]) != (tokeniser, list(keep)):
        raise InvalidInput("the index has another tokeniser or other columns")
    changed = [f.select(F.col(key).alias("id")) for f in (upserts, deletes) if f is not None]
    with scratch():
        if base.revision and changed and (mark := _marked(SegmentIndex(spark, folder, base), reduce(DataFrame.union, changed))):
            parts.append(mark)
        if upserts is not None and (made := _segment(_worded(upserts, key, content, keep, tokeniser), folder, seq)):
            parts.append(made)
    properties |= {"watermark": watermark, "next": seq + 1}
    snapshots.commit(spark, folder, base.revision, parts, properties)
    index = opened(spark, folder)
    dead = sum(p["n"] for p in index.marks)
    if len(index.segments) > MERGE_SEGMENTS or dead > MERGE_DEAD * sum(p["n"] for p in index.segments):
        index = merged(index)
    return index


def merged(index: SegmentIndex) -> SegmentIndex:
    """All live documents as one segment, from stored words: no text is read."""
    seq = index.snapshot.properties["next"]
    made = _segment(index.documents.drop(*PLACE), index.folder, seq)
    found = snapshots.commit(index.spark, index.folder, index.snapshot.revision, [made] if made else [], index.snapshot.properties | {"next": seq + 1})
    return SegmentIndex(index.spark, index.folder, found)


def sync(spark: SparkSession, folder: str, docs: DataFrame, watermark: str | None = None, key: str = "id", content: str = "content", keep: Sequence[str] = (), tokeniser: str = "words") -> SegmentIndex:
    """The index of ``docs`` as they now are, by comparing content hashes: documents that did not change
    are not indexed anew. Nothing is done where ``watermark`` is the index's."""
    index = opened(spark, folder)
    if index is None:
        return update(spark, folder, docs, None, watermark, key, content, keep, tokeniser)
    if watermark is not None and index.watermark == watermark:
        return index
    own = docs.select(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("now"))
    both = index.documents.select("id", "hash").join(own, "id", "full_outer")
    with scratch():
        diff = stored(both.where(~F.col("hash").eqNullSafe(F.col("now"))), "index-diff")
        # kept columns that change with the same content are not noticed
        fresh = docs.join(diff.where("now IS NOT NULL").select(F.col("id").alias(key)), key, "left_semi")
        out = update(spark, folder, fresh, diff.where("now IS NULL").select(F.col("id").alias(key)), watermark, key, content, keep, tokeniser)
        release(diff)
    return out
