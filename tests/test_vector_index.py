"""The vector index against a scan of all vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.operators import retrieval, vector_index
from tessera.plans.catalog import QUERIES

SCHEMA = "id long, vector array<float>"


def clustered(n, dim=16, groups=20, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((groups, dim)) * 3
    return [(k, [float(x) for x in middles[k % groups] + rng.standard_normal(dim)]) for k in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    hot = [(10_000 + k, [1.0] * 16) for k in range(1500)]  # a third of all rows are one vector
    odd = [(20_000, None), (20_001, [0.0] * 16), (20_002, [float("nan")] * 16)]
    return spark.createDataFrame(clustered(3000) + hot + odd, SCHEMA).cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return vector_index.build(rows, f"file://{tmp_path_factory.mktemp('v')}/index", cells=40)


def best(rows, query, k):
    return [(r.id, round(r.score, 9)) for r in retrieval.vector_topk(rows.where("id < 20000"), query, k).collect()]


def test_exact_search_is_the_scan(rows, index):
    assert index.sizes.sum() == 4500
    for query in (clustered(3)[2][1], [1.0] * 16, [-1.0, 2.0] * 8):
        for k in (1, 10, 40):
            assert [(r.id, round(r.score, 9)) for r in index.topk(query, k, probes=2, exact=True).collect()] == best(rows, query, k)
    assert index.topk([1.0] * 16, 5000, exact=True).count() == 4500
    with pytest.raises(InvalidInput):
        index.topk([1.0], 3)


def test_a_query_reads_its_cells_only(rows, index):
    query = clustered(50)[41][1]
    cells = index.near(query, 4)
    read = index.of(cells)
    assert read.count() == index.sizes[cells].sum() < 4500 / 2
    plan = index.topk(query, 10, probes=4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*cell", plan)
    # the bounds leave cells out of the exact search too
    floor = best(rows, query, 10)[-1][1]
    assert 0 < (index.bound(query) >= floor).sum() < len(index.centres) / 2
    near = {r.cell: r.least for r in index.rows.groupBy("cell").agg(F.min("near").alias("least")).collect()}
    assert all(abs(index.least[c] - v) < 1e-12 for c, v in near.items())


def test_recall_of_the_approximate_search(spark, rows, index):
    queries = rows.where("id % 100 = 0 AND id < 20000").select(F.col("id").alias("query_id"), "vector")
    found = {}
    for r in index.batch_topk(queries, 10, probes=6).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 9))
    hit = total = 0
    for q in queries.collect():
        want = best(rows, q.vector, 10)
        assert list(found[q.query_id]) == sorted(found[q.query_id]) and len(found[q.query_id]) == 10
        hit += len({x[1] for x in want} & {x[1] for x in found[q.query_id].values()})
        total += len({x[1] for x in want})
    assert hit >= 0.95 * total
    one = index.topk([float(x) for x in queries.first().vector], 10, probes=6).collect()
    assert [(r.id, round(r.score, 9)) for r in one] == [found[queries.first().query_id][k] for k in range(1, 11)]


def test_recall_on_the_embeddings(spark):
    """Ids divisible by 100 against all rows of sf0.1, at the query's own settings."""
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in QUERIES["vector_index_batch"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    queries = np.flatnonzero(ids % 100 == 0)
    assert set(got) == set(ids[queries].tolist())
    hits = [len(got[ids[q]] & set(ids[np.argsort(-(m @ m[q]), kind="stable")[:10]].tolist())) for q in queries]
    print(f"recall {sum(hits) / (10 * len(queries)):.3f} of {len(queries)} queries over {len(ids)} vectors")
    assert sum(hits) >= 0.9 * 10 * len(queries)


def test_edges(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    assert vector_index.opened(spark, folder) is None
    empty = vector_index.build(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], SCHEMA), folder)
    assert empty.topk([1.0, 2.0], 3).count() == 0 == empty.topk([1.0, 2.0], 3, exact=True).count()
    assert empty.batch_topk(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<float>"), 3).count() == 0
    one = vector_index.build(spark.createDataFrame([(1, [2.0, 0.0])], SCHEMA), folder, watermark="m")
    assert [(r.id, r.score) for r in one.topk([1.0, 0.0], 3, exact=True).collect()] == [(1, 1.0)]
    again = vector_index.opened(spark, folder)
    assert again.snapshot.revision == 2 and again.snapshot.properties["watermark"] == "m" and (again.centres == one.centres).all()
    same = vector_index.build(spark.createDataFrame([(k, [1.0, 1.0]) for k in range(30)], SCHEMA), folder, cells=4)
    assert [r.id for r in same.topk([1.0, 1.0], 3, exact=True).collect()] == [0, 1, 2]
    with pytest.raises(InvalidInput):
        vector_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), folder)
