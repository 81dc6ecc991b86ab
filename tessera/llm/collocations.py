"""Phrase collocation mining by hierarchical pair naming.

A phrase of k words is a pair of two overlapping phrases of k - 1 words. Level by level, the frequent
phrases of the corpus get an id each, from a global count of pairs of ids; the ids are joined back to
the places of the documents, where adjacent ones make the pairs of the next level. An id's pair is also its
two parents, through which the parts of a cut and the phrases inside a longer one are found.

Documents are chunks of some 32 MB of text: a chunk holds the places of its words by names of its own and
one row a different name, so that shuffles carry different names, not words, and a phrase has at most
as many rows as there are chunks, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, release, slices, stored, table
from tessera.llm.words import classes, words

LEAST, TOP, LONGEST = 30, 2_000, 4
#: 100 * f(longer) >= INSIDE * f(phrase): the phrase is no more than a part of the longer one.
INSIDE = 80
KINDS = classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
#: Bytes of text of a chunk, and words; a longer run of text is cut into several.
CHUNK_BYTES, CHUNK_WORDS = 32 << 20, 8_000_000
#: Bits of a name, and of a chunk's number within its task: names and chunks have places of 63 bits.
NAME_BITS, NUMBER_BITS = 23, 18

_PLACES = "chunk long, at long, n long, own int, places binary, names binary"
_WORDS = f"{_PLACES}, lang string, word string"
_PAIRS = f"{_PLACES}, left long, right long"


def _packed(values: np.ndarray) -> bytes:
    """Values from 0 to 2^32 - 1 by planes of bytes, as many as the largest needs."""
    width = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + planes.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u4").ravel()


def _rows(chunk: int, n: np.ndarray, seq: tuple[int, np.ndarray, np.ndarray] | None, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """One row a name, and one with the places if there is a ``seq`` of (own places, places, names)."""
    size, more = len(n), 1 if seq else 0
    null = pa.nulls(1) if more else pa.nulls(0)

    def column(values: pa.Array, last=None) -> pa.Array:
        return pa.concat_arrays([values, pa.array([last] if more else [], values.type)])

    blank = pa.nulls(size, pa.binary())
    own, places, names = seq or (0, np.zeros(0, np.int32), np.zeros(0, np.int32))
    columns = {
        "chunk": pa.array([None] * size + [chunk] * more, pa.int64()),
        "at": column(pa.array((chunk << NAME_BITS) + np.arange(size))),
        "n": column(pa.array(n.astype(np.int64))),
        "own": column(pa.nulls(size, pa.int32()), int(own)),
        "places": column(blank, _packed(np.diff(places, prepend=0))),
        "names": column(blank, _packed(names)),
    }
    columns |= {k: pa.concat_arrays([v, null.cast(v.type)]) for k, v in extra.items()}
    return pa.RecordBatch.from_pydict(columns)


class Gathered:
    """Words of texts as they come, until they are a chunk: a code a word and the different words."""

    def __init__(self):
        self.words: list[pa.DictionaryArray] = []
        self.langs: list[pa.DictionaryArray] = []
        self.cuts: list[np.ndarray] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        texts, row, piece = words(batch.column(1), KINDS)
        if len(texts):
            self.words.append(texts.dictionary_encode())
            self.langs.append(batch.column(0).dictionary_encode().take(pa.array(row)))
            cut = np.ones(len(row), bool)  # texts of different batches are different documents
            cut[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
            self.cuts.append(cut)
        self.size += batch.nbytes

    def chunks(self, first: int, chunk_words: int) -> Iterator[pa.RecordBatch]:
        """The chunks of all words, numbered from ``first``."""
        if not self.words:
            return
        codes, names = [], []
        for held in (self.langs, self.words):  # one after the other, and only what is needed stays
            joined = pa.chunked_array(held).unify_dictionaries()
            held.clear()
            names.append(joined.chunk(0).dictionary)
            codes.append(np.concatenate([c.indices.to_numpy() for c in joined.chunks]))
        del joined
        lang_names, word_names = names
        key = codes[0].astype(np.int64 if len(lang_names) * len(word_names) >> 31 else np.int32, copy=False)
        key *= len(word_names)
        key += codes[1]
        del codes
        places = np.cumsum(np.concatenate(self.cuts), dtype=np.int32)
        places += np.arange(len(key), dtype=np.int32)
        self.__init__()
        for a in range(0, len(key), chunk_words):
            b = min(a + chunk_words, len(key))
            end = min(b + LONGEST - 1, len(key))
            different, names = _renamed(key[a:end], len(lang_names) * len(word_names))
            n = np.bincount(names[: b - a], minlength=len(different))
            lang = lang_names.take(pa.array(different // len(word_names))).cast(pa.string())
            text = word_names.take(pa.array(different % len(word_names))).cast(pa.string())
            own = places[b] if end > b else places[end - 1] + 1
            yield _rows(first, n, (own - places[a], places[a:end] - places[a], names), {"lang": lang, "word": text})
            first += 1


def _renamed(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys, all below ``most``, in order; the place of each key among them)."""
    if most > 4 * len(key) + 1024:
        return np.unique(key, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[key] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[key]


def word_chunks(docs: DataFrame, lang_col: str, text_col: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Chunks of documents: for each a row with its places (places differ by one within a piece only) and
    a row for each of its words, ``at, lang, word, n``; ``at`` is the chunk and the word's name in it. A
    chunk's last places may belong to the next one, for the phrases that begin before; ``own`` is the
    first such place."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << NUMBER_BITS, Gathered()
        for whole in found:
            for batch in slices(whole, 1):
                held.add(batch)
                if held.size >= CHUNK_BYTES:
                    for rows in held.chunks(number, chunk_words):
                        number += 1
                        yield rows
                    pa.default_memory_pool().release_unused()
        yield from held.chunks(number, chunk_words)

    own = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(own, batches, _WORDS)


def pairs(chunks: DataFrame, ids: DataFrame, last: bool) -> DataFrame:
    """The chunks of the next level: adjacent places whose names have ids (``at, id``) make pairs."""

    def of_chunk(seq: pa.Table, known: pa.Table) -> pa.Table:
        empty = _rows(0, np.zeros(0), None, {"left": pa.array([], pa.int64()), "right": pa.array([], pa.int64())})
        if not seq.num_rows or not known.num_rows:
            return pa.Table.from_batches([empty])
        places, names = np.cumsum(_unpacked(seq.column("places")[0].as_py()), dtype=np.int32), _unpacked(seq.column("names")[0].as_py())
        own, chunk = seq.column("own")[0].as_py(), seq.column("chunk")[0].as_py()
        local, id_of = known.column("at").to_numpy() & ((1 << NAME_BITS) - 1), known.column("id").to_numpy()
        rank = np.full(max(int(names.max(initial=0)), int(local.max())) + 1, -1, np.int32)
        rank[local] = np.arange(len(local), dtype=np.int32)
        names = rank[names]
        there = names >= 0
        places, names = places[there], names[there]
        next_to = np.flatnonzero(places[1:] == places[:-1] + 1)
        places, key = places[next_to], names[next_to].astype(np.int64)
        key *= len(id_of)
        key += names[next_to + 1]
        del names, next_to, there
        key, pair = np.unique(key, return_inverse=True)
        n = np.bincount(pair[places < own], minlength=len(key))
        parents = {"left": pa.array(id_of[key // len(id_of)]), "right": pa.array(id_of[key % len(id_of)])}
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([_rows(chunk, n, None if last else (own, places, pair), parents)])

    seqs = chunks.where("at IS NULL").select("chunk", "own", "places", "names")
    ids = ids.select(F.shiftright("at", NAME_BITS).alias("of"), "at", "id")
    return seqs.groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(of_chunk, _PAIRS)


def named(chunks: DataFrame, key: list[str], least: int) -> DataFrame:
    """Names of frequent phrases: ``at, id`` and, on one row a phrase, ``a`` and the ``key``. The id is that
    row's ``at``. One shuffle by the key; what a task holds of a phrase is a row a chunk."""
    phrase = W.partitionBy(*key)
    rows = chunks.where("at IS NOT NULL").select("at", *key, F.sum("n").over(phrase).alias("a"), F.min("at").over(phrase).alias("id")).where(F.col("a") >= least)
    one = F.col("id") == F.col("at")
    return rows.select("at", "id", *[F.when(one, F.col(c)).alias(c) for c in ("a", *key)])


def _score(a: Column, parts: Column) -> Column:
    """``floor(2000000 * a / parts)`` in 128 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000), parts.cast("decimal(20,0)"))


def _phrases(counted: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """Phrases of ``length`` words from the counts of their parents: words, counts of the parts, best cut."""
    parent = ["id", "phrase", "last_word", "a", "first_a", "last_a", "left_a", "right_a"]
    left, right = (shorter.select(*[F.col(c).alias(f"{side}_{c}") for c in parent], *([F.col("lang")] if side == "l" else [])) for side in "lr")
    joined = counted.join(left, F.col("left") == F.col("l_id")).join(right, F.col("right") == F.col("r_id"))
    cuts = {1: ("l_first_a", "r_a"), 2: ("l_left_a", "r_right_a"), length - 1: ("l_a", "r_last_a")} if length == 4 else {1: ("l_first_a", "r_a"), length - 1: ("l_a", "r_last_a")}
    best = F.array_min(F.array(*[F.struct(_score(F.col("a"), F.col(x) + F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in cuts.items()]))
    return joined.select(
        "id", "lang", F.concat_ws(" ", "l_phrase", "r_last_word").alias("phrase"), F.col("r_last_word").alias("last_word"), "a", "left", "right",
        F.col("l_first_a").alias("first_a"), F.col("r_last_a").alias("last_a"), F.col("l_a").alias("left_a"), F.col("r_a").alias("right_a"), best.alias("cut"),
    )


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, inside: int = INSIDE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The leading phrases of 2 to 4 words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A null language is ``und``; null and empty texts have no words. Repeated rows count each. Ties of
    score and count go to the phrase first in UTF-8 order. A language without a candidate has no row;
    an empty table gives none. Other columns are ignored.
    """
    chunks = stored(word_chunks(docs, lang_col, text_col, chunk_words), "phrase-words", compression="zstd")
    totals = stored(chunks.where("at IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    known = stored(named(chunks, ["lang", "word"], least), "phrase-names-1", compression="zstd")
    a = F.col("a")
    level = known.where("a IS NOT NULL").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), "a", a.alias("first_a"), a.alias("last_a"), a.alias("left_a"), a.alias("right_a"))
    level = stored(level, "phrases-1")
    levels: list[DataFrame] = []
    for length in range(2, LONGEST + 1):
        before = chunks, known
        chunks = stored(pairs(chunks, known.select("at", "id"), length == LONGEST), f"phrase-pairs-{length}", compression="zstd")
        release(*before)
        known = stored(named(chunks, ["left", "right"], least), f"phrase-names-{length}", compression="zstd")
        level = stored(_phrases(known.where("a IS NOT NULL").select("id", "a", "left", "right"), level, length), f"phrases-{length}")
        levels.append(level)
    release(chunks, known)
    open_ = []
    for level, longer in zip(levels, [*levels[1:], None], strict=True):
        # what a longer phrase keeps of a part, a phrase between them keeps too, so parents are enough
        if longer is not None:
            within = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("longer_a")).groupBy("id").agg(F.max("longer_a").alias("longer_a"))
            wide = lambda c: F.col(c).cast("decimal(20,0)")
            level = level.join(within, "id", "left").where(F.col("longer_a").isNull() | (100 * wide("longer_a") < inside * wide("a")))
        open_.append(level.select("lang", "phrase", "a", "cut"))
    found = open_[0]
    for more in open_[1:]:
        found = found.unionByName(more)
    found = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM d),
t AS (SELECT id, lang, pn, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p)),
x AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY id, pn ORDER BY k)),
f AS (SELECT lang, [w1] AS g, a FROM (SELECT lang, w1, count(*)::HUGEINT AS a FROM x GROUP BY ALL HAVING count(*) >= 30)
  UNION ALL SELECT lang, [w1, w2], a FROM (SELECT lang, w1, w2, count(*)::HUGEINT AS a FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)
  UNION ALL SELECT lang, [w1, w2, w3], a FROM (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS a FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)
  UNION ALL SELECT lang, [w1, w2, w3, w4], a FROM (SELECT lang, w1, w2, w3, w4, count(*)::HUGEINT AS a FROM x WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)),
c AS (SELECT * FROM f WHERE len(g) > 1),
parts AS (SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, 2000000 * c.a // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
cut AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[i:i + n - 1] AS g, max(a) AS longer FROM (SELECT *, unnest(range(1, len(g) - n + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS n FROM c)) GROUP BY 1, 2),
kept AS (SELECT cut.* FROM cut LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
r AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ') COLLATE "binary") AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
