"""Scans of subtrees read the files that hold them."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import path_table


def test_files_read_follow_the_subtree(spark, tmp_path):
    rows = [(f"/d{k % 20:02d}/s{k % 3}/f{k}", k) for k in range(4000)] + [("/d05", -1), ("/d050/x", -2), ("/d05.txt", -3), ("/d05/é", -4)]
    files = spark.createDataFrame(rows, "path string, n long").repartition(8)
    folder = f"file://{tmp_path}/t"
    path_table.build(files, folder, file_rows=250)
    every = len(path_table.scan(spark, folder).inputFiles())
    assert every >= 14
    for prefix in ("/d05", "d05/", "/d05/s1", "/d19", "/none", "/d05/é", "/"):
        got = path_table.scan(spark, folder, prefix)
        want = files if prefix == "/" else files.where(paths.under(F.col("path"), paths.require_path(prefix, lenient=True)) & (F.col("path") != paths.require_path(prefix, lenient=True)))
        assert {r.n for r in got.collect()} == {r.n for r in want.collect()}, prefix
        assert prefix == "/" or len(got.inputFiles()) <= 3
    plan = path_table.scan(spark, folder, "/d05/s1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(path,/d05/s1/\), LessThan\(path,/d05/s10\)", plan)


@settings(max_examples=60, deadline=None)
@given(st.text("ab/0.é~", min_size=1, max_size=6), st.text("ab/0.é~", max_size=6))
def test_bounds_are_those_of_bytes(prefix, rest):
    low, high = path_table.bounds("/" + prefix.strip("/"))
    own = "/" + prefix.strip("/")
    for path in (own, own + rest, own + "/" + rest):
        assert (low.encode() <= path.encode() < high.encode()) == path.startswith(own.rstrip("/") + "/")
