"""Queries over queues, drift, counters, logs and streams."""

import uuid

from pyspark.sql import functions as F

from tessera import intermediate
from tessera.operators import accounts, state
from tessera.plans.registry import query
from tessera.streaming import events as streams
from tessera.streaming import sinks, timers

NOW = "2024-01-10 12:00:00"
_DUE = f"((status = 'pending' AND available_at <= TIMESTAMP '{NOW}') OR (status = 'processing' AND lease_until <= TIMESTAMP '{NOW}'))"


@query("outbox_claim", f"SELECT id, event_type, workspace_id, CASE WHEN dead THEN 'dead' ELSE 'processing' END AS status, CAST(r AS INT) AS retry_count, CASE WHEN NOT dead THEN TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE END AS lease_until FROM (SELECT *, status = 'processing' AND r >= max_retries AS dead FROM (SELECT *, retry_count + CASE WHEN status = 'processing' THEN 1 ELSE 0 END AS r FROM outbox WHERE {_DUE} ORDER BY id LIMIT 200))", "outbox")
def outbox_claim(r):
    return state.claim(r("outbox"), NOW, 200)


@query("outbox_fail", f"SELECT id, CASE WHEN retry_count + 1 >= 4 THEN 'dead' ELSE 'pending' END AS status, CAST(retry_count + 1 AS INT) AS retry_count, CASE WHEN retry_count + 1 >= 4 THEN available_at ELSE TIMESTAMP '{NOW}' + to_seconds(CAST(least(30 * power(2, least(retry_count + 1, 10)), 3600) AS BIGINT)) END AS available_at, 'boom' AS last_error FROM outbox WHERE status = 'processing' OR status = 'pending'", "outbox")
def outbox_fail(r):
    return state.fail(r("outbox").where("status IN ('processing', 'pending')").withColumn("max_retries", F.lit(4)), NOW, "boom")


@query(
    "worker_cycle",
    f"WITH c AS (SELECT id, r, status = 'processing' AND r >= max_retries AS dead FROM (SELECT *, retry_count + CASE WHEN status = 'processing' THEN 1 ELSE 0 END AS r FROM outbox WHERE {_DUE} ORDER BY id LIMIT 300)), "
    "w AS (SELECT o.*, c.r, c.dead, CASE WHEN c.id IS NULL OR c.dead THEN 'none' WHEN event_type = 'summary_sync' OR (event_type = 'chunk_sync' AND o.id % 2 = 0) THEN 'done' WHEN event_type = 'chunk_sync' THEN 'odd' ELSE 'no handler' END AS e, c.id IS NOT NULL AS taken FROM outbox o LEFT JOIN c ON o.id = c.id) "
    "SELECT id, CASE WHEN NOT taken THEN status WHEN dead THEN 'dead' WHEN e = 'done' THEN 'completed' WHEN r + 1 >= max_retries THEN 'dead' ELSE 'pending' END AS status, "
    "CAST(CASE WHEN NOT taken THEN retry_count WHEN dead OR e = 'done' THEN r ELSE r + 1 END AS INT) AS retry_count, "
    f"CASE WHEN taken AND NOT dead AND e <> 'done' AND r + 1 < max_retries THEN TIMESTAMP '{NOW}' + to_seconds(CAST(least(30 * power(2, least(r + 1, 10)), 3600) AS BIGINT)) ELSE available_at END AS available_at, "
    "CASE WHEN taken AND NOT dead AND e <> 'done' THEN e END AS last_error FROM w",
    "outbox",
)
def worker_cycle(r):
    """Claim, dispatch by type, complete or fail."""
    handlers = {
        "chunk_sync": lambda tasks: tasks.select("id", F.when(F.col("id") % 2 == 1, "odd").alias("error")),
        "summary_sync": lambda tasks: tasks.select("id", F.lit(None).cast("string").alias("error")),
    }
    return state.work_cycle(r("outbox"), NOW, 300, handlers).select("id", "status", "retry_count", "available_at", "last_error")


@query("outbox_complete", "SELECT id, CASE WHEN status = 'processing' AND id % 2 = 1 THEN 'completed' ELSE status END AS status FROM outbox", "outbox")
def outbox_complete(r):
    return state.complete(r("outbox"), r("outbox").where("id % 2 = 1").select("id")).select("id", "status")


@query("outbox_renew", f"SELECT id, CASE WHEN status = 'processing' AND id % 2 = 1 THEN TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE ELSE lease_until END AS lease_until FROM outbox", "outbox")
def outbox_renew(r):
    return state.renew(r("outbox"), r("outbox").where("id % 2 = 1").select("id"), NOW).select("id", "lease_until")


@query("enqueue_dedup", "SELECT DISTINCT event_type, workspace_id, payload FROM outbox WHERE (event_type, workspace_id, payload) NOT IN (SELECT (event_type, workspace_id, payload) FROM outbox WHERE status = 'pending' AND id % 4 = 0)", "outbox")
def enqueue_dedup(r):
    o = r("outbox")
    return state.enqueue(o.where("status <> 'pending' OR id % 4 = 0"), o.select("event_type", "workspace_id", "payload"))


@query("outbox_depth", "SELECT status, count(*) AS n FROM outbox GROUP BY status", "outbox")
def outbox_depth(r):
    return state.depth(r("outbox"))


@query("debounce", f"SELECT path, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 30 SECOND ELSE TIMESTAMP '{NOW}' END AS available_at FROM paths", "paths")
def debounce(r):
    last = r("paths").selectExpr("path", f"TIMESTAMP_NTZ '{NOW}' - INTERVAL '1' MINUTE * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 9 END AS summarized_at")
    return state.debounce(r("paths").select("path"), last, NOW)


@query("fs_events_since", "SELECT id, event_type, path, file_id, created_at FROM fs_events WHERE id > 1000 AND (path = '/u8' OR path LIKE '/u8/%') ORDER BY id LIMIT 40", "fs_events")
def fs_events_since(r):
    return state.events_since(r("fs_events"), 1000, "u8/", 40)


@query("event_bounds", "SELECT min(id) AS min_id, max(id) AS max_id FROM fs_events", "fs_events")
def event_bounds(r):
    return state.cursor_bounds(r("fs_events"), 0).select("min_id", "max_id")


@query("cursor_expiry", "SELECT min(id) AS min_id, max(id) AS max_id, min(id) > 5 AS expired FROM fs_events WHERE id > 50", "fs_events")
def cursor_expiry(r):
    return state.cursor_bounds(r("fs_events").where("id > 50"), 5)


def _drift(r):
    """Against the first chunks of files; an empty file has none to lack."""
    indexed = r("chunks").where("chunk_index = 0 AND substring(file_id, 1, 1) <> 'a'").select("file_id")
    return state.drift(indexed.union(r("dentries").where("is_dir").selectExpr("id")), r("files_meta").where("size_bytes > 0").select("file_id"))


@query("drift_missing", "SELECT file_id FROM files_meta WHERE file_id LIKE 'a%'", "files_meta")
def drift_missing(r):
    return _drift(r)[0]


@query("drift_orphan", "SELECT id AS file_id FROM dentries WHERE is_dir", "dentries")
def drift_orphan(r):
    return _drift(r)[1]


@query("drift_repairs", "SELECT file_id, 'chunk_sync' AS action FROM files_meta WHERE file_id LIKE 'a%' UNION ALL SELECT id, 'chunk_delete' FROM dentries WHERE is_dir", "files_meta", "dentries")
def drift_repairs(r):
    return state.repairs(*_drift(r))


@query("heat_daily", "SELECT day, dentry_id, search_hits, read_count FROM heat", "heat")
def heat_daily(r):
    log = r("events").selectExpr("ts", "'f' || user_id AS dentry_id", "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS search_hits", "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS read_count")
    return state.heat_days(log)


@query("doc_heat", "SELECT d.path, CAST(sum(search_hits) AS BIGINT) AS search_hits, CAST(sum(read_count) AS BIGINT) AS reads FROM heat h JOIN dentries d ON d.id = h.dentry_id WHERE day > DATE '2024-01-01' AND day > DATE '2024-01-31' - 30 GROUP BY d.path ORDER BY reads DESC, path LIMIT 50", "heat", "dentries")
def doc_heat(r):
    return state.doc_heat(r("heat"), r("dentries"), "2024-01-31", 30, "reads")


@query("auth_key_join", "SELECT k.id, k.workspace_id, w.account_id, w.kind FROM api_keys k JOIN workspaces w ON w.id = k.workspace_id WHERE NOT k.revoked AND (k.expires_at IS NULL OR k.expires_at > TIMESTAMP '2024-01-20') AND w.status = 'active'", "api_keys", "workspaces")
def auth_key_join(r):
    return accounts.valid_keys(r("api_keys"), r("workspaces"), "2024-01-20 00:00:00")


@query("workspace_counts", "SELECT w.id AS workspace_id, (SELECT count(*) FROM api_keys k WHERE k.workspace_id = w.id) AS n_keys, (SELECT count(*) FROM outbox o WHERE o.workspace_id = w.id) AS n_tasks FROM workspaces w", "workspaces", "api_keys", "outbox")
def workspace_counts(r):
    return accounts.workspace_counts(r("workspaces"), r("api_keys"), r("outbox"))


@query("workspace_keyword", "SELECT id FROM workspaces WHERE name ILIKE '%0_7%' OR description ILIKE '%0_7%'", "workspaces")
def workspace_keyword(r):
    return r("workspaces").where(accounts.keyword("0_7", "name", "description")).select("id")


@query("qa_list", "SELECT id, outcome, latency_ms, (SELECT count(*) FROM feedback f WHERE f.qa_id = q.id AND f.kind = 1) AS likes, (SELECT count(*) FROM feedback f WHERE f.qa_id = q.id AND f.kind = 2) AS dislikes FROM qa_log q WHERE EXISTS (SELECT 1 FROM feedback f WHERE f.qa_id = q.id AND f.kind = 1)", "qa_log", "feedback")
def qa_list(r):
    return accounts.qa_list(r("qa_log"), r("feedback"), 1)


@query("qa_stats", "WITH l AS (SELECT * FROM qa_log WHERE created_at > TIMESTAMP '2024-01-02') SELECT 'outcome:' || outcome AS name, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT 'feedback:' || kind, count(*) FROM feedback WHERE qa_id IN (SELECT id FROM l) GROUP BY 1", "qa_log", "feedback")
def qa_stats(r):
    return accounts.qa_stats(r("qa_log"), r("feedback"), "2024-01-09 00:00:00", 7)


# streams over the events table, run to its end
def _stream(r):
    schema = r("events").schema
    raw = r.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(r.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(r, name):
    return f"{intermediate.shared_dir(r.spark)}/tessera/stream-{name}-{uuid.uuid4().hex}"


def _appended(r, stream, name):
    return sinks.run_appended(stream, _folder(r, name))


def _merged(r, stream, name, *keys):
    return sinks.run_merged(stream, _folder(r, name), keys)


#: The last watermark of a stream over all events that lets rows be ten minutes late.
_MARK = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_heat", "SELECT day, dentry_id, search_hits, read_count FROM heat", "heat")
def stream_heat(r):
    access = _stream(r).selectExpr("ts", "'f' || user_id AS dentry_id", "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS search_hits", "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS read_count")
    return _merged(r, streams.heat_stream(access), "heat", "day", "dentry_id")


@query("stream_tail", "SELECT event_id AS id, '/u' || user_id || '/' || event_type AS path FROM events WHERE user_id = 8")
def stream_tail(r):
    rows = _stream(r).selectExpr("event_id AS id", "'/u' || user_id || '/' || event_type AS path")
    return _appended(r, streams.tail(rows, "/u8"), "tail")


@query("stream_tumbling", "SELECT start, start + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type FROM events) GROUP BY ALL")
def stream_tumbling(r):
    out = _merged(r, streams.windowed_counts(_stream(r), "tumbling", "1 hour"), "tumbling", "start", "end", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("stream_sliding", "SELECT start, start + INTERVAL 2 HOUR AS \"end\", event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type FROM events, range(0, 2) t(k)) GROUP BY ALL")
def stream_sliding(r):
    out = _merged(r, streams.windowed_counts(_stream(r), "sliding", "2 hours", "1 hour"), "sliding", "start", "end", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("stream_session", "WITH g AS (SELECT ts, event_type, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM (SELECT ts, event_type, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events)) SELECT min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS \"end\", event_type, count(*) AS n FROM g GROUP BY event_type, s")
def stream_session(r):
    """All sessions, those that the watermark has not closed too."""
    out = sinks.run_completed(streams.windowed_counts(_stream(r), "session", "10 minutes"), _folder(r, "session"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT user_id % 50 AS id FROM events")
def stream_dedup(r):
    rows = _stream(r).selectExpr("user_id % 50 AS id", "ts")
    return _appended(r, streams.deduplicated(rows, "90 days"), "dedup").select("id")


@query("stream_static_join", "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_static_join(r):
    joined = _stream(r).join(r("customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")
    return _appended(r, joined, "joined")


@query(
    "stream_leases",
    "WITH o AS (SELECT 'u' || user_id AS task_id, (epoch_us(ts) // 1000) AS ms, event_type = 'purchase' AS done, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_type = 'purchase') AS after FROM events), "
    f"e AS (SELECT task_id, ms + 21600000 AS expired_ms FROM o WHERE NOT done AND (after >= ms + 21600000 OR (after IS NULL AND ms + 21600000 <= (epoch_us({_MARK}) // 1000)))), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY expired_ms) AS INT) AS retries FROM e) SELECT task_id, expired_ms, retries, CASE WHEN retries >= 3 THEN 'dead' ELSE 'pending' END AS status FROM r",
)
def stream_leases(r):
    """Leases of six hours with timers: a sign of a task renews it, a purchase ends it."""
    signs = _stream(r).selectExpr("'u' || user_id AS task_id", "ts", "event_type = 'purchase' AS done")
    return _appended(r, timers.leases(signs, 6 * 3600), "leases")


@query(
    "stream_debounce",
    "WITH g AS (SELECT '/u' || user_id AS directory, (epoch_us(ts) // 1000) AS ms, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), "
    "s AS (SELECT *, sum(CASE WHEN b IS NULL OR ms >= b + 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY directory ORDER BY ms) AS run FROM g), "
    "d AS (SELECT directory, run, count(*) AS n, max(ms) + 43200000 AS due_ms FROM s GROUP BY ALL) "
    f"SELECT directory, n, due_ms FROM d WHERE due_ms <= (epoch_us({_MARK}) // 1000)",
)
def stream_debounce(r):
    changes = _stream(r).selectExpr("'/u' || user_id AS directory", "ts")
    return _appended(r, timers.debounced(changes, 12 * 3600), "debounce")
