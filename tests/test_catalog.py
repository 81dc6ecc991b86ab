"""Every registered query against the SQL that states its result."""

import duckdb
import pytest
from conftest import table_rows

import __spark_entry__ as entry
from tessera.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(compare, name):
    compare(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


#: Documents without text, by every rest of their ids that queries tell apart, some that are longer than a record may be, and
#: folders of two names: /a/b is a source, and of another source a language.
ODD = [(k, text, "en", "src1") for k, text in enumerate(["", None] * 6 + ["a", "b", "c", "h", "é" * 32_767 + "x", "é" * 32_768, "x" * 65_536])]
ODD += [(20, "t", "en", "a/b"), (21, "u", "b", "a"), (22, "v", None, None), (23, "w", "", "")]


@pytest.mark.parametrize("name", ["drift_missing", "drift_orphan", "drift_repairs", "record_validate"])
def test_matches_oracle_on_odd_documents(spark, tmp_path, name):
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert table_rows(got.columns, [tuple(r) for r in got.collect()]) == table_rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score", "path"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
