import duckdb
import pytest
from conftest import table_rows
from pyspark.sql import functions as F

from tessera.errors import Conflict, InvalidInput, NotFound
from tessera.operators import file_table, snapshots
from tessera.plans.catalog import ORACLES, QUERIES
from tessera.streaming import events, sinks, timers


def test_tail_resumes_from_its_checkpoint(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("/a/x").alias("path"))
    rows(0, 5).write.parquet(str(tmp_path / "in" / "p0"))
    seen = []

    def run():
        stream = events.event_stream(spark, str(tmp_path / "in" / "*"), "id long, path string", 10)
        q = events.each_batch(events.tail(stream, "/a"), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "at"))
        q.awaitTermination()

    run()
    rows(5, 8).write.parquet(str(tmp_path / "in" / "p1"))
    run()
    assert sorted(seen) == list(range(8))


def test_cursor(spark):
    log = spark.range(10, 20)
    events.check_cursor(log, 0)
    events.check_cursor(log, 12)
    with pytest.raises(NotFound):
        events.check_cursor(log, 3)


def put(spark, folder, n, rows, schema):
    df = spark.createDataFrame(rows, schema).coalesce(1)  # a file is a batch
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(folder / "in" / f"p{n}"))


def stream_of(spark, folder, schema):
    return events.event_stream(spark, str(folder / "in" / "*"), schema.replace("ts string", "ts timestamp"), 1)


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "ts string, event_type string"
    rows = []

    def run():
        counts = events.windowed_counts(stream_of(spark, tmp_path, schema), "tumbling", "1 hour")
        events.each_batch(counts, lambda df, n: rows.extend(df.collect()), str(tmp_path / "at")).awaitTermination()

    put(spark, tmp_path, 0, [("2024-01-01 00:10:00", "a"), ("2024-01-01 03:00:00", "a")], schema)
    run()
    put(spark, tmp_path, 1, [("2024-01-01 00:20:00", "a"), ("2024-01-01 06:00:00", "a")], schema)
    run()
    counts = {str(r.start): r.n for r in rows}
    assert counts["2024-01-01 00:00:00"] == 1


HEAT = "ts string, dentry_id string, search_hits int, read_count int"


def test_counters_are_merged_across_restarts(spark, tmp_path):
    """A day's counters grow from run to run; what is older than the watermark is final and out of the state."""
    folder = f"file://{tmp_path}/out"

    def run():
        merged = sinks.run_merged(events.heat_stream(stream_of(spark, tmp_path, HEAT)), folder, ["day", "dentry_id"])
        return {(str(r.day), r.dentry_id): (r.search_hits, r.read_count) for r in merged.collect()}

    put(spark, tmp_path, 0, [("2024-01-01 01:00:00", "a", 1, 0), ("2024-01-01 02:00:00", "a", 1, 1), ("2024-01-01 20:00:00", "b", 0, 5)], HEAT)
    first = run()
    assert first == {("2024-01-01", "a"): (2, 1), ("2024-01-02", "b"): (0, 5)}
    put(spark, tmp_path, 1, [("2024-01-01 03:00:00", "a", 7, 0), ("2024-01-09 03:00:00", "c", 1, 1)], HEAT)
    second = run()
    assert second == first | {("2024-01-01", "a"): (9, 1), ("2024-01-09", "c"): (1, 1)}
    put(spark, tmp_path, 2, [("2024-01-01 03:00:00", "a", 100, 0)], HEAT)  # eight days late
    assert run() == second == run()


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    sinks.merge(rows(("a", 1), ("b", 2)), 0, folder, ["k"])
    before = snapshots.current(spark, folder).revision
    sinks.merge(rows(("a", 50)), 0, folder, ["k"])
    assert snapshots.current(spark, folder).revision == before
    sinks.merge(rows(("a", 5), ("c", 3)), 1, folder, ["k"])
    sinks.merge(rows(), 2, folder, ["k"])
    assert {tuple(r) for r in sinks.rows(spark, folder, "k string, v long").collect()} == {("a", 5), ("b", 2), ("c", 3)}
    # only the buckets of the batch's keys are rewritten
    parts = {p["bucket"]: p["path"] for p in snapshots.current(spark, folder).parts}
    sinks.merge(rows(("b", 9)), 3, folder, ["k"])
    now = {p["bucket"]: p["path"] for p in snapshots.current(spark, folder).parts}
    assert sum(parts[b] != now[b] for b in parts) == 1


def test_appended_rows_survive_a_restart(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/out", "id long, path string"
    spark.range(0, 4).select("id", F.lit("/a").alias("path")).write.parquet(str(tmp_path / "in" / "p0"))
    run = lambda: {r.id for r in sinks.run_appended(events.event_stream(spark, str(tmp_path / "in" / "*"), schema), folder).collect()}
    assert run() == {0, 1, 2, 3}
    spark.range(4, 6).select("id", F.lit("/a").alias("path")).write.parquet(str(tmp_path / "in" / "p1"))
    assert run() == set(range(6)) == run()


def test_debounce_and_leases_across_batches(spark, tmp_path):
    """Timers that are set in one batch run out, or are put off, in another."""
    changes = "ts string, directory string"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    for n, rows in enumerate([[(at(0), "/a"), (at(5), "/a"), (at(0), "/b")], [(at(20), "/a"), (at(33), "/b")], [(at(59), "/c")], [(at(300), "/z")], [(at(1200), "/z")]]):
        put(spark, tmp_path / "d", n, rows, changes)
    got = sinks.run_appended(timers.debounced(stream_of(spark, tmp_path / "d", changes), 30, "0 seconds"), f"file://{tmp_path}/d/out").collect()
    base = 1704067200
    # /a: three changes closer than 30 s; /b: quiet at 30, again at 63; the last change of /z waits still
    assert {(r.directory, r.n, r.due_ms // 1000 - base) for r in got} == {("/a", 3, 50), ("/b", 1, 30), ("/b", 1, 63), ("/c", 1, 89), ("/z", 1, 330)}

    signs = "ts string, task_id string, done boolean"
    batches = [[(at(0), "t", False), (at(0), "u", False), (at(0), "v", False)], [(at(40), "t", False), (at(50), "u", True)], [(at(110), "t", False), (at(300), "w", False)], [(at(400), "t", False), (at(900), "w", True)], [(at(1500), "x", False)]]
    for n, rows in enumerate(batches):
        put(spark, tmp_path / "l", n, rows, signs)
    got = sinks.run_appended(timers.leases(stream_of(spark, tmp_path / "l", signs), 60, 2, "0 seconds"), f"file://{tmp_path}/l/out").collect()
    want = {("t", 100, 1, "pending"), ("t", 170, 2, "dead"), ("t", 460, 3, "dead"), ("v", 60, 1, "pending"), ("w", 360, 1, "pending")}
    assert {(r.task_id, r.expired_ms // 1000 - base, r.retries, r.status) for r in got} == want


def minutes(spark, sf_dir):
    """300 users' events on whole tens of minutes, so that ends of runs, marks and times of events meet."""
    event_type = "CASE WHEN pmod(hash(id, 3), 5) = 0 THEN 'purchase' ELSE 'view' END"
    ts = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 10 * pmod(hash(id), 1000))"
    rows = spark.range(6000).selectExpr("id AS event_id", f"{ts} AS ts", "CAST(pmod(hash(id, 7), 300) AS BIGINT) AS user_id", f"{event_type} AS event_type")
    # one run is due between the last mark and the last event, and ended by a change
    late = spark.createDataFrame([(6000, 9275, 1000), (6001, 9997, 1000), (6002, 10_000, 1001)], "event_id long, m int, user_id long")
    rows = rows.union(late.selectExpr("event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, m)", "user_id", "'view'"))
    rows.coalesce(1).write.parquet(f"{sf_dir}/written")
    next(sf_dir.glob("written/*.parquet")).rename(sf_dir / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["stream_debounce", "stream_session", "stream_leases"])
def test_ends_that_meet(spark, tmp_path, name):
    """A run that a later change ends is due only by the watermark; what begins as another ends is another."""
    con = minutes(spark, tmp_path)
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert table_rows(got.columns, [tuple(r) for r in got.collect()]) == table_rows(want.columns, want.fetchall())


def test_open_sessions_count_across_restarts(spark, tmp_path):
    schema, folder = "ts string, event_type string", f"file://{tmp_path}/out"
    run = lambda: {(str(r.start)[11:16], str(r.end)[11:16], r.n) for r in sinks.run_completed(events.windowed_counts(stream_of(spark, tmp_path, schema), "session", "10 minutes"), folder).collect()}
    put(spark, tmp_path, 0, [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:09:00", "a")], schema)
    assert run() == {("00:00", "00:19", 2)}
    put(spark, tmp_path, 1, [("2024-01-01 00:12:00", "a"), ("2024-01-01 00:22:00", "a")], schema)
    assert run() == {("00:00", "00:22", 3), ("00:22", "00:32", 1)} == run()


def test_writes_that_expect_a_revision(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/files"
    rows = lambda *x: spark.createDataFrame([(*r, None) if len(r) == 2 else r for r in x], "path string, content string, expected_revision int")
    state = lambda: {r.path: (r.revision, r.size_bytes) for r in file_table.files(spark, folder).collect()}
    file_table.write(folder, rows(("/a", "x"), ("/b", "yy", 0)))
    first = snapshots.current(spark, folder).revision
    assert file_table.write(folder, rows(("/a", "x"))).revision == first  # equal content is no revision
    file_table.write(folder, rows(("/a", "xxx", 1), ("/c", "z")))
    assert state() == {"/a": (2, 3), "/b": (1, 2), "/c": (1, 1)}
    for wrong in (("/a", "q", 1), ("/a", "q", 0), ("/new", "q", 4)):
        with pytest.raises(Conflict):
            file_table.write(folder, rows(("/b", "not written"), wrong))
    with pytest.raises(InvalidInput):
        file_table.write(folder, rows(("/a", "1"), ("/a", "2")))
    assert state()["/b"] == (1, 2)
    assert {r.path for r in file_table.files(spark, folder, first).collect()} == {"/a", "/b"}  # readers of an older revision

    # two writers that have seen revision 2 of /a: one loses; a third, of another path, is merged in
    true = snapshots.commit
    pending = [rows(("/a", "theirs", 2))]

    def commit(*args):
        if pending:
            own = pending.pop()
            file_table.write(folder, own)
        return true(*args)

    monkeypatch.setattr(snapshots, "commit", commit)
    with pytest.raises(Conflict, match="/a has revision 3"):
        file_table.write(folder, rows(("/a", "ours", 2)))
    pending.append(rows(("/d", "theirs")))
    file_table.write(folder, rows(("/b", "ours", 1)))
    assert state() == {"/a": (3, 6), "/b": (2, 4), "/c": (1, 1), "/d": (1, 6)}


def test_shared_content_is_forked(spark, tmp_path):
    folder = f"file://{tmp_path}/files"
    rows = lambda *x: spark.createDataFrame(list(x), "path string, content string")
    file_table.write(folder, rows(("/a", "same"), ("/b", "same")))
    ids = {r.path: r.file_id for r in file_table.files(spark, folder).collect()}
    assert ids["/a"] == ids["/b"]
    file_table.write(folder, rows(("/b", "other")))
    now = {r.path: r.file_id for r in file_table.files(spark, folder).collect()}
    assert now["/a"] == ids["/a"] != now["/b"]
    file_table.write(folder, rows(("/a", "alone")))
    assert {r.path: r.file_id for r in file_table.files(spark, folder).collect()}["/a"] == ids["/a"]  # sole owner: in place
