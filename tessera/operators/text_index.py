"""BM25 over postings by term, document lengths and corpus statistics, wherever they come from."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directories of stored postings.
BUCKETS = 64
K1, B = 1.2, 0.75


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(BUCKETS)).cast("int")


def bucket_of(term: str) -> int:
    """``bucket`` of a literal."""
    return zlib.crc32(term.encode("utf-8")) % BUCKETS


@dataclass(frozen=True)
class TextIndex:
    """postings: bucket, term, id, tf, dl. lengths: id, dl and the columns kept. stats: n, avgdl, one row."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame

    tokeniser: str = "words"

    def topk(self, terms: Sequence[str], k: int) -> DataFrame:
        """id, score of documents, the ``k`` best among them."""
        return self.scores(terms)

    def scores(self, terms: Sequence[str], scope: DataFrame | None = None) -> DataFrame:
        """id, score of documents with one of ``terms``. With ``scope`` (id), those documents are the
        corpus: frequencies and lengths are theirs alone."""
        terms = sorted(set(terms))
        found = self.postings.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms))
        stats = self.stats
        if scope is not None:
            found = found.join(scope.select("id"), "id", "left_semi")
            stats = self.lengths.join(scope.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        # a row a term, and one of statistics
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
        return known.groupBy("id").agg(F.sum(weight()).alias("score"))


def weight() -> Column:
    """A term's part of a document's score, from tf, dl, df, n and avgdl."""
    tf, df, n = F.col("tf"), F.col("df"), F.col("n")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
