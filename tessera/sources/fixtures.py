"""The engine's relations derived from the star-schema and corpus tables.

Each relation is one SQL text over other relations, so that another engine can derive the same
rows: ``duck`` gives it as common table expressions, ``relation`` as a DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE_TS = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


@dataclass(frozen=True)
class Relation:
    sql: str
    #: DuckDB's text where it differs by more than ``_to_duck`` covers.
    duck: str | None = None


def _to_spark(text: str) -> str:
    text = re.sub(r"SHA256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", text)
    return re.sub(r"BYTES\((\w+)\)", r"octet_length(\1)", text)


def _to_duck(text: str) -> str:
    text = re.sub(r"BYTES\((\w+)\)", r"strlen(\1)", text).replace("SHA256(", "sha256(").replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return re.sub(r"\{(\w+)\}", r"\1", text)


LINES = "length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR right(content, 1) = chr(10) THEN 0 ELSE 1 END"

RELATIONS: dict[str, Relation] = {
    "paths": Relation(
        "SELECT doc_id, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || CAST(doc_id AS STRING) || '.txt' AS path, "
        "'/' || coalesce(source, 'none') || '/' || coalesce(lang, 'und') AS parent_path, CAST(doc_id AS STRING) || '.txt' AS name, "
        "SHA256(coalesce(text, '')) AS file_id, coalesce(text, '') AS content, "
        f"{BASE_TS} + doc_id * INTERVAL '1' MINUTE AS created_at FROM {{documents}}"
    ),
    "files_meta": Relation(
        "SELECT file_id, CAST(max(size_bytes) AS BIGINT) AS size_bytes, 'text/plain' AS mime_type, 1 AS revision, file_id AS checksum, CAST(count(*) AS INT) AS ref_count, "
        "CAST(max(line_count) AS INT) AS line_count, CASE WHEN max(size_bytes) <= 262144 THEN 'inline' ELSE 'chunked' END AS storage_type, 'text' AS source_type, "
        "min(created_at) AS created_at, max(created_at) AS updated_at "
        f"FROM (SELECT file_id, created_at, BYTES(content) AS size_bytes, {LINES} AS line_count FROM {{paths}}) GROUP BY file_id"
    ),
    "contents": Relation("SELECT file_id, min(content) AS content FROM {paths} GROUP BY file_id"),
    "dentries": Relation(
        "SELECT 'f' || CAST(doc_id AS STRING) AS id, parent_path, name, path, file_id, false AS is_dir, created_at, created_at AS updated_at FROM {paths} "
        f"UNION ALL SELECT 'd' || path, '/', substring(path, 2), path, NULL, true, {BASE_TS}, {BASE_TS} FROM (SELECT DISTINCT '/' || coalesce(source, 'none') AS path FROM {{documents}}) "
        f"UNION ALL SELECT 'd' || s || l, s, substring(l, 2), s || l, NULL, true, {BASE_TS}, {BASE_TS} "
        "FROM (SELECT DISTINCT '/' || coalesce(source, 'none') AS s, '/' || coalesce(lang, 'und') AS l FROM {documents})"
    ),
    "chunks": Relation(
        "SELECT file_id || '_' || CAST(k AS STRING) AS id, file_id, CAST(k AS INT) AS chunk_index, substring(content, CAST(k * 512 + 1 AS INT), 512) AS content "
        "FROM (SELECT file_id, content, explode(sequence(0, greatest(CAST(ceil(length(content) / 512.0) AS INT) - 1, 0))) AS k FROM {contents}) WHERE content <> ''",
        "SELECT file_id || '_' || CAST(k AS VARCHAR) AS id, file_id, CAST(k AS INT) AS chunk_index, substring(content, CAST(k * 512 + 1 AS INT), 512) AS content "
        "FROM (SELECT file_id, content, unnest(range(0, greatest(CAST(ceil(length(content) / 512.0) AS INT), 1))) AS k FROM contents) WHERE content <> ''",
    ),
    "file_chunks": Relation(
        "SELECT file_id, chunk_index, CAST(1 + 4 * chunk_index AS INT) AS start_line, CAST(size(part) AS INT) AS line_count, "
        "octet_length(array_join(part, chr(10))) + CASE WHEN 4 * (chunk_index + 1) < n THEN 1 ELSE 0 END AS byte_len, array_join(part, chr(10)) AS content "
        "FROM (SELECT file_id, chunk_index, n, slice(lines, 4 * chunk_index + 1, 4) AS part FROM "
        "(SELECT file_id, lines, size(lines) AS n, explode(sequence(0, CAST(ceil(size(lines) / 4.0) AS INT) - 1)) AS chunk_index FROM "
        "(SELECT file_id, split(content, chr(10)) AS lines FROM {contents} WHERE content <> '')))",
        "SELECT file_id, chunk_index, CAST(1 + 4 * chunk_index AS INT) AS start_line, CAST(len(part) AS INT) AS line_count, "
        "CAST(strlen(array_to_string(part, chr(10))) + CASE WHEN 4 * (chunk_index + 1) < n THEN 1 ELSE 0 END AS INT) AS byte_len, array_to_string(part, chr(10)) AS content "
        "FROM (SELECT file_id, chunk_index, n, lines[4 * chunk_index + 1:4 * chunk_index + 4] AS part FROM "
        "(SELECT file_id, lines, len(lines) AS n, CAST(unnest(range(0, CAST(ceil(len(lines) / 4.0) AS INT))) AS INT) AS chunk_index FROM "
        "(SELECT file_id, string_split(content, chr(10)) AS lines FROM contents WHERE content <> '')))",
    ),
    "summaries": Relation(
        "SELECT p.file_id AS file_id, NULL AS dentry_id, 'F: ' || substring(min(p.content), 1, 60) AS l0_abstract, substring(min(p.content), 1, 200) AS l1_overview, "
        "CASE WHEN count(l.doc_id) > 0 THEN 'ready' ELSE 'pending' END AS status FROM {paths} p LEFT JOIN {labels} l ON p.doc_id = l.doc_id GROUP BY p.file_id "
        "UNION ALL SELECT NULL, id, 'D: ' || path, 'directory ' || path, 'ready' FROM {dentries} WHERE is_dir AND parent_path <> '/'"
    ),
    "summary_vectors": Relation(
        "SELECT p.file_id AS id, e.embedding AS vector FROM (SELECT file_id, min(doc_id) AS vec_id FROM {paths} GROUP BY file_id) p JOIN {embeddings} e ON e.vec_id = p.vec_id "
        "UNION ALL SELECT d.id, e.embedding FROM {dentries} d JOIN {embeddings} e ON e.vec_id = length(d.path) WHERE d.is_dir AND d.parent_path <> '/'"
    ),
    "chunk_vectors": Relation(
        "SELECT c.id, e.embedding AS vector FROM {chunks} c JOIN (SELECT file_id, min(doc_id) AS vec_id FROM {paths} GROUP BY file_id) p ON p.file_id = c.file_id JOIN {embeddings} e ON e.vec_id = p.vec_id WHERE c.chunk_index = 0"
    ),
    "vectors": Relation(
        "SELECT 'ds' || CAST(vec_id % 3 AS STRING) || ':v' || CAST(vec_id AS STRING) AS pk, 'v' || CAST(vec_id AS STRING) AS id, 'ds' || CAST(vec_id % 3 AS STRING) AS dataset, "
        "'c' || CAST(label AS STRING) AS category, array('t' || CAST(label % 2 AS STRING), 't' || CAST(2 + vec_id % 5 AS STRING)) AS tags, vec_id, embedding AS vector, "
        "chr(123) || '\"price\":' || CAST(vec_id * 7 % 300 AS STRING) || ',\"brand\":\"b' || CAST(vec_id % 4 AS STRING) || '\",\"hot\":' || CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END || chr(125) AS meta, "
        "CASE WHEN vec_id % 10 = 9 THEN 'deleted' ELSE 'active' END AS status FROM {embeddings}",
        "SELECT 'ds' || CAST(vec_id % 3 AS VARCHAR) || ':v' || CAST(vec_id AS VARCHAR) AS pk, 'v' || CAST(vec_id AS VARCHAR) AS id, 'ds' || CAST(vec_id % 3 AS VARCHAR) AS dataset, "
        "'c' || CAST(label AS VARCHAR) AS category, ['t' || CAST(label % 2 AS VARCHAR), 't' || CAST(2 + vec_id % 5 AS VARCHAR)] AS tags, vec_id, embedding AS vector, "
        "chr(123) || '\"price\":' || CAST(vec_id * 7 % 300 AS VARCHAR) || ',\"brand\":\"b' || CAST(vec_id % 4 AS VARCHAR) || '\",\"hot\":' || CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END || chr(125) AS meta, "
        "CASE WHEN vec_id % 10 = 9 THEN 'deleted' ELSE 'active' END AS status FROM embeddings",
    ),
    "fs_events": Relation(
        "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'update' WHEN 'click' THEN 'create' WHEN 'purchase' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'summary_ready' END AS event_type, "
        "'/u' || CAST(user_id AS STRING) || '/' || event_type AS path, CASE WHEN event_id % 2 = 0 THEN 'f' || CAST(user_id AS STRING) END AS file_id, ts AS created_at FROM {events}"
    ),
    "access_log": Relation(
        "SELECT 'f' || CAST(user_id AS STRING) AS dentry_id, CAST(ts + INTERVAL '8' HOUR AS DATE) AS day, "
        "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS search_hits, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS read_count FROM {events}"
    ),
    "heat": Relation("SELECT day, dentry_id, CAST(sum(search_hits) AS BIGINT) AS search_hits, CAST(sum(read_count) AS BIGINT) AS read_count FROM {access_log} GROUP BY day, dentry_id"),
    "outbox": Relation(
        "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'chunk_sync' WHEN 1 THEN 'summary_sync' ELSE 'dir_summary_sync' END AS event_type, "
        "'w' || CAST(user_id % 4 AS STRING) AS workspace_id, chr(123) || '\"file_id\":\"f' || CAST(user_id AS STRING) || '\"' || chr(125) AS payload, "
        "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'pending' ELSE 'dead' END AS status, "
        "CAST(event_id % 5 AS INT) AS retry_count, 5 AS max_retries, ts AS available_at, CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL '10' MINUTE END AS lease_until, ts AS updated_at FROM {events}"
    ),
    "memories": Relation(
        "SELECT conv_id * 100 + turn AS id, CASE conv_id % 3 WHEN 0 THEN 'workspace' WHEN 1 THEN 'principal' ELSE 'dept' END AS scope_type, "
        "CASE conv_id % 3 WHEN 0 THEN 'w' ELSE CASE conv_id % 3 WHEN 1 THEN 'p' ELSE 'd' END END || CAST(conv_id % 4 AS STRING) AS scope_id, "
        "CASE WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN 'w' || CAST(conv_id % 2 AS STRING) END AS origin_workspace_id, "
        "CASE WHEN turn % 3 = 0 THEN NULL ELSE 'topic' || CAST(turn % 3 AS STRING) END AS topic, CASE WHEN role = 'user' THEN 'preference' ELSE 'fact' END AS kind, "
        f"text AS content, SHA256(text) AS content_hash, CASE WHEN turn % 4 = 3 THEN {BASE_TS} + conv_id * INTERVAL '1' HOUR END AS expires_at, "
        f"{BASE_TS} + turn * INTERVAL '1' DAY AS created_at FROM {{conversations}}"
    ),
    "qa_log": Relation(
        "SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 4 = 0 THEN 'answered' WHEN turn % 4 = 2 THEN 'refused' ELSE 'failed' END AS outcome, "
        f"CAST(length(text) AS INT) AS latency_ms, CAST(turn AS INT) AS hit_count, {BASE_TS} + conv_id * INTERVAL '1' HOUR AS created_at FROM {{conversations}} WHERE role <> 'system'"
    ),
    "feedback": Relation("SELECT doc_id AS id, (doc_id % 60) * 100 + toxic + quality AS qa_id, CASE WHEN quality = 1 THEN 1 ELSE 2 END AS kind FROM {labels}"),
    "workspaces": Relation(
        "SELECT 'w' || CAST(s_suppkey AS STRING) AS id, s_name AS name, 'a' || CAST(s_nationkey AS STRING) AS account_id, CASE WHEN s_suppkey % 3 = 0 THEN 'db' ELSE 'fs' END AS kind, "
        "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'space of ' || s_name END AS description, CASE WHEN s_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status FROM {supplier}"
    ),
    "api_keys": Relation(
        "SELECT c_custkey AS id, 'w' || CAST(c_custkey % 120 AS STRING) AS workspace_id, 'vk_' || substring(c_name, 10, 20) AS token, "
        f"CASE WHEN c_custkey % 5 = 0 THEN {BASE_TS} + c_custkey * INTERVAL '1' HOUR END AS expires_at, c_custkey % 7 = 0 AS revoked FROM {{customer}}"
    ),
    "principals": Relation(
        f"SELECT c_custkey AS id, c_name AS display_name, 'd' || CAST(c_nationkey AS STRING) AS dept_id, {BASE_TS} + c_custkey * INTERVAL '7' MINUTE AS profile_at FROM {{customer}}"
    ),
}
_DEPENDS = re.compile(r"\{(\w+)\}")


def depends(name: str) -> list[str]:
    return list(dict.fromkeys(_DEPENDS.findall(RELATIONS[name].sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a relation derived from them."""
    if name not in RELATIONS:
        return table(spark, sf_dir, name)
    parts = {d: relation(spark, sf_dir, d) for d in depends(name)}
    return spark.sql(_to_spark(RELATIONS[name].sql), **parts)


def duck(query: str, *names: str) -> str:
    """``query`` for DuckDB after the common table expressions of ``names`` and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in RELATIONS and name not in order:
            for d in depends(name):
                add(d)
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return query
    ctes = ",\n".join(f"{n} AS ({RELATIONS[n].duck or _to_duck(RELATIONS[n].sql)})" for n in order)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    return f"WITH {ctes},\n{body[4:].strip()}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
