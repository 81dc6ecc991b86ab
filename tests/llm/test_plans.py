"""What the operators' plans must and must not have."""

import re

import pytest

from tessera.llm import decontaminate, exact_dedup, near_dup, registry, shared


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_decontaminate", "op5_url_filter"])
def test_native_operators_run_no_python(spark, sf, name):
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan(registry.queries()[name](spark, sf)))


def test_exact_dedup_combines_before_each_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(exact_dedup.exact_dedup(docs))
    assert text.count("partial_min") >= 2
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_scans_read_only_their_columns(spark, sf):
    for name in ("op4_pii", "op6_token_count", "op7_sentencepiece"):
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(registry.queries()[name](spark, sf))


def test_benchmark_index_keeps_rare_terms_only(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    grams, _ = decontaminate.benchmark_windows(items)
    anchors = decontaminate.rarest_terms(docs, grams, "doc_id", "text")
    assert anchors.groupBy("wid").count().where("count > 2").isEmpty()
    index = decontaminate.postings(docs, anchors, "doc_id", "text")
    tokens = decontaminate.tokens(docs, "doc_id", "text").count()
    assert 0 < index.count() < tokens / 4


def test_batches_are_bounded_by_bytes(spark):
    df = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', 5000) AS text")

    def sizes(found):
        import pyarrow as pa

        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    assert max(r.n for r in shared.mapped(df, sizes, "n long").collect()) * 5000 <= 2 * shared.BATCH_BYTES


def test_no_pairs_of_a_large_group(spark, monkeypatch):
    """Links out of a group of near copies grow with its size, not with its square."""
    n = 600
    rows = [(k, " ".join(f"w{j}" if j != k % 90 else f"v{k}" for j in range(100))) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    monkeypatch.setattr(near_dup, "stored", lambda df, name, **k: made.append((name, (out := shared.stored(df, name, **k)).count())) or out)
    assert near_dup.near_duplicates(docs, words=4).select("component_id").distinct().count() == 1
    assert sum(rows for name, rows in made if name in ("hub-pairs", "candidates")) <= 12 * n
    # as many writes as there are steps: none for a document or a class
    assert len(made) <= 16 + 2 * sum(name.startswith("open") for name, _ in made)
