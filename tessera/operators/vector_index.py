"""A stored index of inverted cells for vector search by cosine.

Vectors of unit length are filed under the nearest of a set of centres, which k-means finds on a bounded
sample; every vector is indexed. A query reads the cells whose centres are nearest to it and ranks
their vectors exactly. Each cell keeps the least cosine of a vector to its centre, which bounds what the
cell can hold for a query: with that bound the exact answer is found without reading all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.operators import snapshots
from tessera.operators.retrieval import cosine, top

#: Vectors that the centres are fitted on, the number of centres at most, and rounds of k-means.
SAMPLE, MAX_CELLS, ROUNDS = 50_000, 2_048, 8
#: Directories of cells, and files a directory that a large cell's vectors are dealt to.
BUCKETS, SPREAD = 64, 4
PROBES = 8


def unit(vector: Column) -> Column:
    """In doubles and of unit length; null where there is no direction."""
    own = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(own, lambda x: x / norm))


def cells_for(n: int) -> int:
    """About the square root of the number of vectors."""
    return max(1, min(MAX_CELLS, round(math.sqrt(max(n, 1)))))


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    snapshot: snapshots.Snapshot
    #: (cells, dimensions), rows of unit length; the least cosine of each cell's vectors; how many it has.
    centres: np.ndarray
    least: np.ndarray
    sizes: np.ndarray

    @property
    def rows(self) -> DataFrame:
        """cell, id, vector, cosine to the centre, bucket."""
        return self.spark.read.schema(self.snapshot.properties["schema"]).parquet(f"{self.snapshot.parts[0]['path']}/cells")

    def near(self, query: Sequence[float], probes: int = PROBES) -> list[int]:
        """The cells with the nearest centres."""
        if not self.sizes.sum():
            return []
        q = np.asarray(query, float)
        return np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()

    def of(self, cells: Sequence[int]) -> DataFrame:
        """The vectors of some cells: their directories, and within them their row groups."""
        return self.rows.where(F.col("bucket").isin(sorted({c % BUCKETS for c in cells})) & F.col("cell").isin(sorted(cells)))

    def bound(self, query: Sequence[float]) -> np.ndarray:
        """The largest cosine that each cell can hold: angles to a centre add up at best."""
        q = np.asarray(query, float) / (np.linalg.norm(query) or 1.0)
        angle = np.arccos(np.clip(self.centres @ q, -1, 1)) - np.arccos(np.clip(self.least, -1, 1))
        return np.where(self.sizes > 0, np.cos(np.maximum(angle, 0)), -np.inf)

    def topk(self, query: Sequence[float], k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """id, score, score_type of the best in the probed cells, or of all vectors if ``exact``: then the
        cells are read that could hold one better than the k-th of those probed."""
        if len(query) != self.centres.shape[1] and self.sizes.sum():
            raise InvalidInput("the query has another number of dimensions")
        cells = self.near(query, probes)
        if exact and cells:
            floor = self._scored(cells, query, k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            best = self.bound(query)
            enough = floor["n"] >= min(k, int(self.sizes.sum()))
            cells = np.flatnonzero(best >= (floor["least"] - 1e-8 if enough and floor["n"] else -2)).tolist()
        return self._scored(cells, query, k).withColumn("score_type", F.lit("cosine"))

    def _scored(self, cells: Sequence[int], query: Sequence[float], k: int) -> DataFrame:
        return top(self.of(cells).select("id", cosine(F.col("vector"), query).alias("score")), k)

    def batch_topk(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """query_id, id, score, rank for queries (query_id, vector): each meets the vectors of its cells in a
        join on the cell, and each task keeps k candidates of a query at most. A query without a direction
        finds nothing."""
        if not self.sizes.sum():
            return queries.select("query_id").limit(0).crossJoin(self.rows.select("id").limit(0)).selectExpr("query_id", "id", "0D AS score", "0 AS rank")
        centres = self.centres
        count = min(probes, len(centres))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
                if not b.num_rows:
                    continue
                found = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :count].astype(np.int32)
                at = np.repeat(np.arange(b.num_rows), count)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(found.ravel())], names=["query_id", "q", "cell"])

        own = queries.select("query_id", unit(F.col("vector")).alias("q")).where("q IS NOT NULL")
        kind = dict(queries.dtypes)["query_id"]
        probed = own.mapInArrow(probe, f"query_id {kind}, q array<double>, cell int")
        # a large cell's vectors lie in parts, so that its queries are not one task's
        part = F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")
        vectors = self.rows.select("cell", part.alias("part"), "id", unit(F.col("vector")).alias("v"))
        dealt = probed.withColumn("part", F.explode(F.array(*[F.lit(p) for p in range(SPREAD)])))
        met = dealt.join(vectors, ["cell", "part"]).select("query_id", "id", "cell", "part", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
        order = (F.desc(F.round("score", 9)), F.col("id"))
        # first within a cell's part, then over all of a query: k rows from each
        first = met.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "cell", "part").orderBy(*order))).where(F.col("r") <= k)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        return ranked.where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def build(vectors: DataFrame, folder: str, cells: int | None = None, watermark: str | None = None, key: str = "id", vector: str = "vector", seed: int = 7) -> VectorIndex:
    """Writes the index of ``vectors`` as the next revision and opens it. Vectors that are null, zero or not
    finite have no direction and are left out, as no search finds them. All have one dimension."""
    spark = vectors.sparkSession
    base = snapshots.current(spark, folder)
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), unit(F.col(vector)).alias("u")).where("u IS NOT NULL")
    n, short, wide = own.agg(F.count(F.lit(1)), F.min(F.size("u")), F.max(F.size("u"))).first()
    if short != wide:
        raise InvalidInput("vectors of different dimensions")
    wanted = min(cells or cells_for(n), max(n, 1))
    centres = np.zeros((1, 0))
    if wanted > 1:
        drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, round(1_200_000 * min(1.0, SAMPLE / n)))
        # a limit leaves one partition, which would be one task in every round
        sample = own.where(drawn).limit(SAMPLE).select(array_to_vector("u").alias("f")).repartition(spark.sparkContext.defaultParallelism)
        found = np.array(KMeans(k=wanted, maxIter=ROUNDS, seed=seed, distanceMeasure="cosine", featuresCol="f").fit(sample).clusterCenters())
        centres = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    elif n:
        centres = np.array([own.limit(1).first()["u"]])

    def file_under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ centres.T
            cell = near.argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(near[np.arange(len(cell)), cell])], names=["id", "vector", "cell", "near"])

    kinds = dict(own.dtypes)
    schema = f"id {kinds['id']}, vector {kinds['vector']}, cell int, near double, bucket int"
    filed = own.mapInArrow(file_under, schema.removesuffix(", bucket int")).withColumn("bucket", F.col("cell") % BUCKETS)
    path = snapshots.new_part(folder)
    dealt = filed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "cell", "id")
    dealt.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{path}/cells")
    if n:
        stats = spark.read.schema(schema).parquet(f"{path}/cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least")).collect()  # a row a cell
    else:
        stats = []
    least, sizes = np.ones(len(centres)), np.zeros(len(centres), int)
    for r in stats:
        least[r["cell"]], sizes[r["cell"]] = r["least"], r["n"]
    table = [(k, centres[k].tolist(), float(least[k]), int(sizes[k])) for k in range(len(centres))]
    spark.createDataFrame(table, "cell int, centre array<double>, least double, n long").coalesce(1).write.parquet(f"{path}/centres")
    made = snapshots.commit(spark, folder, base.revision, [{"path": path, "n": n}], {"watermark": watermark, "schema": schema})
    return VectorIndex(spark, folder, made, centres, least, sizes)


def opened(spark: SparkSession, folder: str) -> VectorIndex | None:
    """The last revision, or none."""
    found = snapshots.current(spark, folder)
    if not found.revision:
        return None
    rows = spark.read.parquet(f"{found.parts[0]['path']}/centres").orderBy("cell").collect()  # at most MAX_CELLS
    return VectorIndex(spark, folder, found, np.array([r["centre"] for r in rows]).reshape(len(rows), -1), np.array([r["least"] for r in rows]), np.array([r["n"] for r in rows]))
