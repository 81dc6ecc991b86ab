"""Batches, retries and the stored dictionary of embeddings."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import embeddings


def test_batches_are_ordered_and_tried_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider(texts):
        with open(log, "a+") as f:
            f.seek(0)
            n = len(f.readlines())
            f.write(f"{len(texts)}\n")
        if n < 2:
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(k, None if k == 4 else "x" * k) for k in range(11)], "k int, text string").coalesce(1)
    got = {r.k: r.vector for r in embeddings.embedded(rows, provider, batch=4, wait_s=0.01).collect()}
    assert got == {k: None if k == 4 else [float(k)] for k in range(11)}
    assert [int(x) for x in open(log)] == [4, 4, 4, 4, 2]
    with pytest.raises(RuntimeError):
        embeddings.called(lambda t: (_ for _ in ()).throw(RuntimeError("down")), ["a"], 2, 0.0)
    with pytest.raises(ValueError):
        embeddings.called(lambda t: [], ["a"], 2, 0.0)


def test_dictionary_expires_and_is_bounded(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    frame = lambda *x: spark.createDataFrame([(k, t) for k, t in enumerate(x)], "k int, text string")

    def run(at, *texts, **more):
        found = embeddings.cached(frame(*texts), folder, f"2024-01-0{1 + at // 24} {at % 24:02d}:30:00", "m", idle_h=10, **more).collect()
        assert all((r.vector is not None) == bool((r.text or "").strip()) for r in found)
        return {r.text: r.hit for r in found}

    long = "word " * 2000
    assert run(0, "a", " a ", "b", "", None, long) == {"a": False, " a ": False, "b": False, "": False, None: False, long: False}
    assert embeddings.dictionary(spark, folder).count() == 2  # one for both spellings, none of the long text
    assert run(5, "a", "c", long) == {"a": True, "c": False, long: False}
    assert run(14, "a", "b", "c") == {"a": True, "b": False, "c": True}  # b was idle for too long
    assert run(23, "a") == {"a": True}
    assert run(25, "a", "b") == {"a": False, "b": False}  # a is over a day old, b idle
    run(26, *[f"t{k}" for k in range(30)], entries=8)
    assert embeddings.dictionary(spark, folder).count() == 8


def test_the_bound_is_not_one_task(spark):
    rows = spark.range(0, 2000, 1, 8).selectExpr("sha2(CAST(id AS STRING), 256) AS cache_key", "array(CAST(id AS FLOAT)) AS vector", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, id % 2) AS made_at", "TIMESTAMP_NTZ '2024-01-02 00:00:00' + make_dt_interval(0, id % 3) AS used_at")
    whole = [r.cache_key for r in rows.orderBy(F.desc("used_at"), F.desc("made_at"), "cache_key").collect()]
    for n in (1, 333, 334, 1500, 1999, 2000, 5000):
        assert {r.cache_key for r in embeddings._latest(rows, n).collect()} == set(whole[:n]) and embeddings._latest(rows, n).count() == min(n, 2000)
    assert embeddings._latest(rows, 1900).select(F.spark_partition_id().alias("p"), "cache_key").groupBy("p").count().count() > 1
