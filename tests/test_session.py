import json

import pytest

from tessera.errors import InvalidInput, PermissionDenied
from tessera.session import Engine


@pytest.fixture
def engine(spark):
    return Engine(spark, {"t": spark.range(3)})


@pytest.mark.parametrize("text", ["CREATE TABLE x (a INT)", "DROP VIEW t", "INSERT INTO t VALUES (1)", "SET a=b", "CREATE VIEW v AS SELECT 1", "DELETE FROM t", "TRUNCATE TABLE t", "SHOW TABLES", "CACHE TABLE t", "UPDATE t SET id = 1"])
def test_commands_are_refused(engine, text):
    with pytest.raises(PermissionDenied):
        engine.sql(text)


@pytest.mark.parametrize("text", ["SELECT id FROM t", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT id FROM t UNION SELECT 7", "VALUES (1)", "SELECT id FROM t EXCEPT SELECT 1"])
def test_queries_run(engine, text):
    assert engine.sql(text).count() > 0


def test_bad_sql_is_the_callers_fault(engine):
    for text in ("SELEC 1", "SELECT nope FROM t", "SELECT * FROM nowhere"):
        with pytest.raises(InvalidInput):
            engine.sql(text)


def test_rows_are_json(engine):
    assert [json.loads(x) for x in engine.rows("SELECT id, CAST(NULL AS INT) AS n FROM t WHERE id = 2")] == [{"id": 2}]


def test_writes_need_a_writable_session(spark):
    with pytest.raises(PermissionDenied):
        Engine(spark).require_writable()


def test_table_function_over_paths(spark):
    """Columns depend on the path: a table with a header, lines, JSON lines, a listing."""
    import pytest

    from tessera.errors import InvalidInput, NotFound
    from tessera.session import Engine
    from tessera.sources import formats

    files = {"/d/a.csv": 'x,"long\nname"\n1,"a (b"\n2,c\n', "/d/b.txt": "one\ntwo\n", "/d/c.jsonl": '{"k": 1}\n', "/d/o'neil.txt": "q"}
    dentries = spark.createDataFrame([(p, p[3:], f"f{k}", False, "/d") for k, p in enumerate(files)] + [("/d", "d", None, True, "/")], "path string, name string, file_id string, is_dir boolean, parent_path string")
    contents = spark.createDataFrame([(f"f{k}", v) for k, v in enumerate(files.values())], "file_id string, content string")
    engine = Engine(spark, functions={"fs": lambda path: formats.read_path(dentries, contents, path)})
    rows = lambda q: [tuple(r) for r in engine.sql(q).collect()]
    assert engine.sql("SELECT * FROM fs('/d/a.csv')").columns == ["_line_number", "x", "long\nname", "_path"]
    assert rows("SELECT x, `long\nname` AS y FROM FS('/d/a.csv') WHERE x > 0 ORDER BY x") == [(1, "a (b"), (2, "c")]
    assert rows("SELECT upper(line) AS l FROM fs('/d/b.txt') AS t WHERE t.line <> 'fs(''x'')' ORDER BY _line_number") == [("ONE",), ("TWO",)]
    assert rows("SELECT line FROM fs('/d/o\\'neil.txt')") == [("q",)]
    assert rows("WITH a AS (SELECT * FROM fs('/d/b.txt')) SELECT count(*), (SELECT max(x) FROM fs('/d/a.csv')) FROM a JOIN fs('/d/b.txt') b ON a.line = b.line") == [(2, 2)]
    assert rows("SELECT 1 WHERE EXISTS (SELECT * FROM fs('/d/c.jsonl')) AND 2 IN (SELECT x FROM fs('/d/a.csv'))") == [(1,)]
    for wrong in ("SELECT * FROM fs(concat('/d', '/b.txt'))", "SELECT * FROM fs()", "SELECT * FROM fs(NULL)"):
        with pytest.raises(InvalidInput):
            engine.sql(wrong)
    with pytest.raises(NotFound):
        engine.sql("SELECT * FROM fs('/none')")
