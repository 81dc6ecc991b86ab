"""Appends at chunk level against chunking whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import QuotaExceeded
from tessera.operators import chunked, pipeline, snapshots


def test_appends_equal_chunking_the_whole(spark, tmp_path):
    folder, rng = f"file://{tmp_path}/c", random.Random(5)
    texts: dict[str, str] = {}
    for step in range(5):
        more = {f"f{k}": "".join(rng.choice(["word ", "é\n", "\n", "long " * 9]) for _ in range(rng.randint(0, 60))) for k in rng.sample(range(8), 5)}
        texts = {k: texts.get(k, "") + more.get(k, "") for k in {*texts, *more}}
        chunked.append(folder, spark.createDataFrame(sorted(more.items()), "file_id string, content string"), size=64)
        if step == 3:
            chunked.compacted(spark, folder)
        got = {tuple(r) for r in chunked.chunks(spark, folder).collect()}
        whole = spark.createDataFrame(sorted(texts.items()), "file_id string, content string")
        assert got == {tuple(r) for r in pipeline.storage_chunks(whole, 64).collect()}
    assert {r.file_id: r.content for r in chunked.contents(chunked.chunks(spark, folder)).collect()} == {k: v for k, v in texts.items() if v}


def test_only_tails_are_written(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    frame = lambda **x: spark.createDataFrame(sorted(x.items()), "file_id string, content string")
    chunked.append(folder, frame(a="line\n" * 400, b="x\n" * 400), size=100)
    before = chunked.chunks(spark, folder).count()
    made = chunked.append(folder, frame(a="more\n"), size=100)
    assert spark.read.parquet(f"{made.parts[-1]['path']}/rows").count() <= 2 and made.parts[-1]["replaced"] == 1
    assert before <= chunked.chunks(spark, folder).count() <= before + 1
    assert chunked.append(folder, frame(a="", z="")).revision == made.revision  # empty appends are none
    with pytest.raises(QuotaExceeded):
        chunked.append(folder, frame(a="y" * 1000, c="fits"), most=2500)
    assert snapshots.current(spark, folder).revision == made.revision
    assert chunked.chunks(spark, folder).where(F.col("file_id") == "c").isEmpty()
