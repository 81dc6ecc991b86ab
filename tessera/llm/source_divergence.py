"""Source divergence audit: how far the words of each source are from those of the others of its language.

The distance of two sources is a sum over all kept terms, most of which neither has. It is taken
apart: a histogram of each source's counts prices its terms as if the other had none of them, a join
of postings corrects the terms that both have, and what neither has costs a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import mapped, sized, slices, stored, table
from tessera.llm.words import classes, coded, words

#: Documents of a language that a kept term is in at least.
LEAST_DOCS = 10
TOP_TERMS = 10
#: Sources of one term that meet in one tile of the posting join, at most about so many.
TILE = 1_024
#: Groups up to which their statistics are broadcast.
BROADCAST_GROUPS = 100_000
#: All but letters and what is beyond ASCII.
KINDS = classes(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, summed within batches only."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for batch in slices(whole, 2, 4 << 20):
                terms, row, _ = words(batch.column(2), KINDS)
                if not len(terms):
                    continue
                term, names = coded(terms)
                langs, lang_names = coded(batch.column(0))
                sources, source_names = coded(batch.column(1))
                _, first, n = np.unique(row * len(names) + term, return_index=True, return_counts=True)  # by document
                group = langs[row[first]] * len(source_names) + sources[row[first]]
                key, where = np.unique(group * len(names) + term[first], return_inverse=True)
                group = key // len(names)
                columns = [
                    lang_names.take(pa.array(group // len(source_names))),
                    source_names.take(pa.array(group % len(source_names))),
                    names.take(pa.array(key % len(names))).cast(pa.string()),
                    pa.array(np.bincount(where, n, len(key)).astype(np.int64)),
                    pa.array(np.bincount(where, minlength=len(key)).astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return mapped(own, batches, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """Kept terms of each source: ``lang, term, source, n``, with the term's count in the language
    (``n_lang``), the number of sources that have it, and a mark on one row a term."""
    counts = term_counts(docs, lang_col, source_col, text_col)
    summed = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    marked = summed.select(
        "lang", "term", "source", "n",
        F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("n_lang"),
        F.count(F.lit(1)).over(term).alias("n_sources"), (F.min("source").over(term) == F.col("source")).alias("one"),
    )
    return marked.where(F.col("docs") >= least_docs).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(1000000000 * (n + 2) / (total + 2 * terms))``, exact for counts of any size; null without terms."""
    top, below = (n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000), (total + 2 * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", top, below))


F_SQL = "(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def distance(p: str, q: str) -> Column:
    """``floor((p - q)^2 / (p + q))``; shares are at most 10^9 + 1, so that squares fit 64 bits."""
    return F.expr(F_SQL.format(p=p, q=q))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE) -> DataFrame:
    """One row per pair of sources of a language and per leading term of a source:
    ``lang, source, part ('pair' or 'term'), item, value, rank``.

    Null languages, sources and texts are empty strings. Repeated rows count each. A source without
    a term is compared all the same; where a language keeps no term every pair has the value 0. Ties
    go to the item first in UTF-8 order. An empty table gives no rows; other columns are ignored.
    """
    kept = stored(postings(docs, lang_col, source_col, text_col, least_docs), "divergence-postings")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("one").alias("terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "support", "lang_total", "terms"])
    groups = groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = stored(groups, "divergence-groups")

    priced = kept.join(sized(groups, BROADCAST_GROUPS), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("support").alias("item_support"))
    apart = F.col("source") != F.col("item")
    # neither has the term, as if no term were in both
    rest = groups.join(other, "lang").where(apart).select("lang", "source", "item", F.coalesce((F.col("terms") - F.col("support") - F.col("item_support")) * distance("zero", "item_zero"), F.lit(0)).alias("v"))
    # one of both has it
    histogram = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h"))
    one = histogram.join(other, "lang").where(apart).groupBy("lang", "source", "item").agg(F.sum(F.col("h") * distance("p", "item_zero")).alias("v"))
    # both have it: postings of a term meet in tiles of two blocks of its sources
    blocks = F.ceil(F.col("n_sources") / tile).cast("int")
    block = F.pmod(F.xxhash64("source"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = priced.select("lang", "term", block.alias("i"), every.alias("j"), "source", "p", "zero")
    right = priced.select("lang", "term", every.alias("i"), block.alias("j"), F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("item_zero"))
    met = left.join(right, ["lang", "term", "i", "j"]).where("source < item")
    gain = distance("p", "q") - distance("p", "item_zero") - distance("zero", "q") + distance("zero", "item_zero")
    both = met.select("lang", "source", "item", gain.alias("v")).groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))
    half = one.unionByName(both)
    turned = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    pairs = rest.unionByName(half).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    terms = priced.withColumn("q", share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS lang_total FROM kept GROUP BY lang),
p AS (SELECT kept.lang, tot.source, kept.term, coalesce(c.n, 0) AS n,
  1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (tot.total + 2 * v.v) AS p, 1 + (1000000000 * (kept.n + 2)) // (v.lang_total + 2 * v.v) AS q
  FROM kept JOIN v USING (lang) JOIN tot USING (lang) LEFT JOIN c ON c.lang = kept.lang AND c.source = tot.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary" ASC)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
