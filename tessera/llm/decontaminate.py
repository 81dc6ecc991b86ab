"""Benchmark decontamination with a positional inverted index of the training tokens.

Two passes read the corpus. The first counts how often each benchmark term occurs. The second
stores the postings (document, position) of the terms that are among the rarest of some
benchmark window, the index on which lists are intersected: each list is moved back by its
term's offset in the window, so that equal starts mean the terms stand as in the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_lower, scratch, sized, stored, table, unused

#: A word before A-Z are lower-cased: ASCII letters, digits and all beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WINDOW = 10
#: Share of a window's words that a proximity match has.
PROXIMITY = 0.8
#: Lists intersected per window, from the rarest term on.
LISTS = 2
#: Rows of a term or window table up to which it is broadcast (a few dozen MB); beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words as written; ``ascii_lower`` is left to where few are left to compare."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(distinct windows: wid, gram, n; windows of items: wid, item_id)."""
    own = items.select(F.col(item_col).cast("string").alias("item_id"), words(ascii_lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = own.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("gram"))
    each = each.withColumn("wid", F.xxhash64("gram"))
    return each.select("wid", "gram", F.size("gram").alias("n")).distinct(), each.select("wid", "item_id").distinct()


#: What names a document: its id, and a hash of its text, for rows without an id or that repeat one.
KEY = ["doc_id", "tkey"]


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """The columns ``KEY``, with a value in place of null ids, which no join finds."""
    kind = dict(docs.dtypes)[id_col]
    nothing = F.lit("" if kind == "string" else -1).cast(kind)
    return F.coalesce(F.col(id_col), nothing).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey")


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tkey, pos, word (as written). The outer form keeps Spark from cutting each text twice, once to
    ask whether it has words."""
    own = docs.select(*_key(docs, id_col, text_col), words(F.col(text_col)).alias("w"))
    return own.select(*KEY, F.posexplode_outer("w").alias("pos", "word")).where("word IS NOT NULL")


def keyed(terms: DataFrame) -> DataFrame:
    return terms.withColumn("key", F.lower("term"))


def matched(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Tokens joined to ``terms`` on the word with A-Z lower-cased. ``lower`` is fast, but
    lower-cases beyond ASCII; so it makes the join's key and the few such words are compared again."""
    word = F.col("word")
    same = (F.length(word) == F.octet_length(word)) | (ascii_lower(word) == F.col("term"))
    return found.withColumn("key", F.lower(word)).join(terms, "key").where(same)


def rarest_terms(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, lists: int = LISTS) -> DataFrame:
    """wid, k (0: the rarest), offset, term for the ``lists`` rarest terms of each window that can occur.

    A window with a term that the corpus lacks is left out. Frequencies are of the whole corpus.
    """
    spread = grams.select("wid", F.posexplode("gram").alias("offset", "term"), "n")
    terms = sized(keyed(spread.select("term").distinct()), BROADCAST_ROWS)
    counted = matched(tokens(docs, id_col, text_col).select("word"), terms).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    placed = spread.join(counted, "term")
    by = Window.partitionBy("wid")
    return (
        placed.withColumn("there", F.count(F.lit(1)).over(by))
        .withColumn("k", F.row_number().over(by.orderBy("freq", "offset")) - 1)
        .where((F.col("there") >= F.col("n")) & (F.col("k") < lists))
        .select("wid", "k", "offset", "term")
    )


def postings(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index: term, doc_id, tkey, pos."""
    terms = sized(keyed(anchors.select("term").distinct()), BROADCAST_ROWS)
    return matched(tokens(docs, id_col, text_col), terms).select("term", *KEY, "pos")


def _checked(docs: DataFrame, candidates: DataFrame, grams: DataFrame, condition: Column, id_col: str, text_col: str) -> DataFrame:
    """Candidates (KEY, wid, start, n) for which ``condition`` holds on the words ``w`` of the document and the
    window's ``gram``. Only documents with candidates are cut into words, each once."""
    some = sized(candidates.select(*KEY).distinct(), BROADCAST_ROWS)
    texts = docs.select(*_key(docs, id_col, text_col), F.col(text_col).alias("text")).join(some, KEY, "left_semi").dropDuplicates(KEY)
    wanted = sized(candidates.join(sized(grams.select("wid", "gram"), BROADCAST_ROWS), "wid"), BROADCAST_ROWS)
    return texts.select(*KEY, words(F.col("text")).alias("w")).join(wanted, KEY).where(condition).select(*KEY, "wid", "start", "n")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(matches: doc_id, tkey, wid, start, n, exact; windows of items: wid, item_id).

    ``slop`` 0 returns exact phrases. A larger one adds proximity matches (``exact`` false): at least
    ``PROXIMITY`` of the window's words, its two rarest terms among them, stand in one document
    within ``slop`` words of where the rarest puts them.
    """
    grams, of_items = benchmark_windows(items, window)
    grams = stored(grams, "windows")
    anchors = stored(rarest_terms(docs, grams, id_col, text_col), "anchors")
    index = stored(postings(docs, anchors, id_col, text_col), "postings")
    wanted = sized(anchors.join(grams.select("wid", "n"), "wid"), BROADCAST_ROWS)
    lists = index.join(wanted, "term").select("wid", *KEY, (F.col("pos") - F.col("offset")).alias("start"), "k", "n")
    rare, other = lists.where("k = 0").drop("k"), lists.where("k = 1").select("wid", *KEY, "start")
    met = rare.where("n > 1").join(other, ["wid", *KEY, "start"], "left_semi").unionByName(rare.where("n = 1"))
    met = stored(met.where("start >= 0").distinct(), "candidates")
    start, n = F.col("start"), F.col("n")
    same = F.transform(F.slice("w", start + 1, n), ascii_lower) == F.col("gram")
    exact = stored(_checked(docs, met, grams, same, id_col, text_col).withColumn("exact", F.lit(True)), "exact-matches")
    if not slop:
        return exact, of_items
    # starts within slop share a block of slop + 1 or lie in adjoining ones
    block = F.floor(start / (slop + 1))
    far = rare.where("n > 1").select("wid", *KEY, "start", "n", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    close = other.select("wid", *KEY, start.alias("other_start"), block.alias("block"))
    within = F.abs(start - F.col("other_start")) <= slop
    loose = stored(far.join(close, ["wid", *KEY, "block"]).where(within).select(*KEY, "wid", "start", "n").distinct(), "loose-candidates")
    # every word of the window is looked for around its place
    there = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.exists(
            F.slice("w", F.greatest(start + j - slop, F.lit(0)) + 1, F.greatest(start + j + slop + 1 - F.greatest(start + j - slop, F.lit(0)), F.lit(0))),
            lambda word: ascii_lower(word) == F.get("gram", j),
        ),
    )
    enough = F.size(F.filter(there, lambda hit: hit)) >= F.ceil(PROXIMITY * n)
    near = _checked(docs, loose, grams, enough, id_col, text_col)
    return exact.unionByName(near.join(exact, [*KEY, "wid", "start"], "left_anti").withColumn("exact", F.lit(False))), of_items


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and no hits; items without words match nothing. Rows that
    repeat an id, and rows without one, each return with the hits of their own text. Columns other
    than those named are ignored.
    """
    with scratch() as hold:
        found, of_items = occurrences(docs.select(id_col, text_col), items, id_col, text_col, window)
        found = hold(stored(found, "matches"))
    hit = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hits = hit.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    of = found.select(*KEY, "wid").join(of_items, "wid").select(*KEY, "item_id").distinct()
    of = of.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("ids"))
    all_docs = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    all_docs = all_docs.select("own", *_key(all_docs, "own", "text"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return (
        all_docs.join(hits, KEY, "left")
        .join(of, KEY, "left")
        .select(
            F.col("own").alias("doc_id"),
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns, whose names are
    free. Rows without an id and rows that repeat one are judged by their own texts."""
    with scratch() as hold:
        found, _ = occurrences(docs.select(id_col, text_col), items, id_col, text_col, window)
        names = [unused(docs, x) for x in KEY]
        hit = hold(stored(found.select(*[F.col(k).alias(n) for k, n in zip(KEY, names, strict=True)]).distinct(), "contaminated"))
    own = [unused(docs, f"own_{x}") for x in KEY]
    marked = docs.withColumns(dict(zip(own, _key(docs, id_col, text_col), strict=True)))
    same = [F.col(a) == F.col(b) for a, b in zip(own, names, strict=True)]
    return marked.join(hit.hint("merge"), same, "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT x.doc_id, x.s, x.n, g.item_id
      FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g))) x
      JOIN g ON x.gram = g.gram AND x.n = g.n),
h AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
