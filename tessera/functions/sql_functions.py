"""Functions of the SQL surface with SQL bodies: they stay inside Catalyst, a lookup of a path is a
join and not a call for each row.

They read the views ``files``, ``contents``, ``dentries``, ``files_meta``, ``fs_events``, the text
index's ``postings`` (rows of blocks), ``text_ids`` and ``text_stats``, ``chunks`` and ``vectors_of`` (id, vector) of the session they
are registered in; ``search`` also calls ``embedding`` (text to vector) there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.errors import InvalidInput
from tessera.functions import text
from tessera.operators import text_index

_UNDER = "(coalesce(prefix, '/') = '/' OR path = rtrim('/', prefix) OR startswith(path, concat(rtrim('/', prefix), '/')))"

#: Scores (id, score) in r by the stored index, views ``postings``, ``text_ids`` and ``text_stats``. Only rows of the query's terms are opened.
_BM25 = (
    f"q AS (SELECT DISTINCT term, pmod(crc32(encode(term, 'UTF-8')), {text_index.BUCKETS}) AS bucket FROM (SELECT explode(regexp_extract_all(lower(query), '{text.TOKEN.replace(chr(92), chr(92) * 2)}', 0)) AS term)), "
    "o AS (SELECT term, seq, block, inline(arrays_zip(ats, tfs, dls)) AS (at, tf, dl) FROM (SELECT /*+ BROADCAST(q) */ p.* FROM postings p JOIN q ON p.bucket = q.bucket AND p.term = q.term)), "
    "t AS (SELECT o.*, i.id FROM o JOIN text_ids i ON o.seq = i.seq AND o.block = i.block AND o.at = i.at), "
    "f AS (SELECT term, count(*) AS df FROM t GROUP BY term), "
    "r AS (SELECT t.id, sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / s.avgdl))) AS score FROM t JOIN f ON t.term = f.term CROSS JOIN text_stats s GROUP BY t.seq, t.block, t.at, t.id)"
)
#: The limit in lim (k); unknown modes and limits that are not positive are errors.
_LIMIT = (
    "lim AS (SELECT CASE WHEN coalesce(mode, 'hybrid') NOT IN ('hybrid', 'semantic', 'fulltext') THEN CAST(raise_error(concat('search: mode ', mode)) AS INT) "
    "WHEN n <= 0 THEN CAST(raise_error('search: the limit must be positive') AS INT) ELSE least(coalesce(n, 10), 100) END AS k)"
)

#: The limit of ``events_since``: literals fold to a number, so that only so many rows are sorted.
_EVENTS = (
    "CASE WHEN n < 0 THEN CAST(raise_error('events_since: the limit is negative') AS INT) WHEN since < 0 THEN CAST(raise_error('events_since: the first id is negative') AS INT) "
    "ELSE least(coalesce(n, 1000), 100000) END"
)

SCALARS = {
    "path_parent": ("p STRING", "STRING", "CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(p, '^(.*)/[^/]*$', 1) END"),
    "path_name": ("p STRING", "STRING", "substring_index(p, '/', -1)"),
    "token_estimate": ("x STRING", "BIGINT", r"CAST(ceil(length(regexp_replace(x, '[^\\x00-\\x7F]', '')) / 4) AS BIGINT) + length(x) - length(regexp_replace(x, '[^\\x00-\\x7F]', ''))"),
    "file_exists": ("p STRING", "BOOLEAN", "CASE WHEN p IS NOT NULL THEN p = '/' OR (SELECT count(*) > 0 FROM dentries d WHERE d.path = p) END"),
    "file_size": ("p STRING", "BIGINT", "(SELECT max(f.size_bytes) FROM files f WHERE f.path = p)"),
    "file_mtime": ("p STRING", "STRING", "(SELECT max(f.updated_at) FROM files f WHERE f.path = p)"),
    "file_read": ("p STRING", "STRING", "(SELECT max(c.content) FROM dentries d JOIN contents c ON d.file_id = c.file_id WHERE d.path = p)"),
}

TABLES = {
    "events_since": (
        "since BIGINT DEFAULT 0, prefix STRING DEFAULT NULL, n INT DEFAULT 1000",
        "id BIGINT, event_type STRING, path STRING, file_id STRING, created_at TIMESTAMP_NTZ",
        f"SELECT id, event_type, path, file_id, created_at FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM fs_events WHERE id > coalesce(since, 0) AND {_UNDER}) WHERE rn <= {_EVENTS} "
        f"UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS TIMESTAMP_NTZ) FROM (SELECT {_EVENTS} AS k) WHERE k < 0",  # none: the arguments are checked though nothing is found
    ),
    "storage_totals": (
        "",
        "total_files BIGINT, total_directories BIGINT, total_bytes BIGINT",
        "SELECT count_if(NOT d.is_dir), count_if(d.is_dir), coalesce(sum(m.size_bytes), 0) FROM dentries d LEFT JOIN files_meta m ON d.file_id = m.file_id",
    ),
    "grep_lines": (
        "pattern STRING, prefix STRING DEFAULT '/'",
        "path STRING, line_no BIGINT, line STRING",
        f"SELECT path, CAST(pos + 1 AS BIGINT), rtrim(chr(13), line) FROM (SELECT d.path, posexplode(split(regexp_replace(c.content, '\\\\n\\\\z', ''), '\\\\n')) AS (pos, line) FROM dentries d JOIN contents c ON d.file_id = c.file_id WHERE c.content <> '' AND contains(c.content, pattern) AND {_UNDER.replace('path', 'd.path')}) WHERE contains(line, pattern)",
    ),
    "search_text": (
        "query STRING, n INT DEFAULT 10",
        "id STRING, score DOUBLE, rank INT",
        f"WITH {_BM25} SELECT id, score, rank FROM (SELECT id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM r) WHERE rank <= n",
    ),
    "search": (
        "query STRING, mode STRING DEFAULT 'hybrid', n INT DEFAULT 10",
        "id STRING, file_id STRING, chunk_index INT, content STRING, score DOUBLE, score_type STRING, path STRING",
        f"WITH {_BM25}, {_LIMIT}, "
        "e AS (SELECT embedding(query) AS x), "
        "v AS (SELECT id, aggregate(zip_with(vector, x, (a, b) -> a * b), 0D, (s, t) -> s + t) / sqrt(aggregate(vector, 0D, (s, t) -> s + t * t) * aggregate(x, 0D, (s, t) -> s + t * t)) AS score "
        "FROM (SELECT id, transform(vector, t -> CAST(t AS DOUBLE)) AS vector, transform(x, t -> CAST(t AS DOUBLE)) AS x FROM vectors_of CROSS JOIN e)), "
        "dense AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM v WHERE score IS NOT NULL), "
        "sparse AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM r), "
        "one AS (SELECT id, score, 'cosine' AS score_type, 'semantic' AS kind FROM dense WHERE rank <= 100 UNION ALL SELECT id, score, 'bm25', 'fulltext' FROM sparse WHERE rank <= 100 UNION ALL "
        "SELECT id, sum(1 / (60 + rank)), 'rrf', 'hybrid' FROM (SELECT id, rank FROM dense WHERE rank <= 100 UNION ALL SELECT id, rank FROM sparse WHERE rank <= 100) CROSS JOIN lim WHERE rank <= k GROUP BY id), "
        "hits AS (SELECT id, score, score_type FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM one WHERE kind = coalesce(mode, 'hybrid')) CROSS JOIN lim WHERE rank <= k), "
        "found AS (SELECT h.*, c.file_id, c.chunk_index, c.content FROM hits h JOIN chunks c ON c.id = h.id), "
        "alias AS (SELECT d.file_id, min(d.path) AS path FROM dentries d LEFT SEMI JOIN found ON d.file_id = found.file_id GROUP BY d.file_id) "
        "SELECT f.id, f.file_id, f.chunk_index, f.content, f.score, f.score_type, a.path FROM found f LEFT JOIN alias a ON a.file_id = f.file_id "
        "UNION ALL SELECT CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM lim WHERE k < 0",  # none: the arguments are checked though nothing is found
    ),
}


def register(spark: SparkSession, *names: str) -> None:
    """Creates the named functions, or all, as temporary functions of the session."""
    for name in names or (*SCALARS, *TABLES):
        if name in SCALARS:
            params, kind, body = SCALARS[name]
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        elif name in TABLES:
            params, columns, body = TABLES[name]
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({columns}) RETURN {body}")
        else:
            raise InvalidInput(f"function: {name!r}")
