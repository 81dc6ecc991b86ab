"""Queries that call the SQL surface's functions through the facade."""

from tessera.functions import sql_functions
from tessera.operators import fs
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import _COS, VECTOR, WORDS, _bm25, _rrf, chunk_index
from tessera.session import Engine


def _engine(r, functions, *names):
    engine = Engine(r.spark, {n: r(n) for n in names if n != "files"})
    if "files" in names:
        engine.register("files", fs.files_view(r("dentries"), r("files_meta")))
    sql_functions.register(r.spark, *functions)
    return engine


@query("tvf_events_since", "SELECT id, path FROM fs_events WHERE id > 500 AND (path = '/u8' OR path LIKE '/u8/%') ORDER BY id LIMIT 20", "fs_events")
def tvf_events_since(r):
    return _engine(r, ["events_since"], "fs_events").sql("SELECT id, path FROM events_since(since => 500, prefix => '/u8/', n => 20)")


@query("tvf_storage_totals", "SELECT count(*) FILTER (WHERE NOT is_dir) AS total_files, count(*) FILTER (WHERE is_dir) AS total_directories, CAST(sum(m.size_bytes) AS BIGINT) AS total_bytes FROM dentries d LEFT JOIN files_meta m ON d.file_id = m.file_id", "dentries", "files_meta")
def tvf_storage_totals(r):
    return _engine(r, ["storage_totals"], "dentries", "files_meta").sql("SELECT * FROM storage_totals()")


@query("tvf_grep", "SELECT path, count(*) AS n FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM paths WHERE path LIKE '/src1/%') WHERE contains(line, 'threre') GROUP BY path", "paths")
def tvf_grep(r):
    return _engine(r, ["grep_lines"], "dentries", "contents").sql("SELECT path, count(*) AS n FROM grep_lines('threre', '/src1') GROUP BY path")


@query("tvf_search", f"WITH {_bm25('chunks')} SELECT id, round(score, 6) AS score FROM q ORDER BY round(score, 9) DESC, id LIMIT 10", "chunks")
def tvf_search(r):
    return _indexed(r, chunk_index(r), ["search_text"]).sql(f"SELECT id, round(score, 6) AS score FROM search_text('{WORDS}', 10)")


def _indexed(r, index, functions):
    engine = Engine(r.spark, {"postings": index.blocks, "text_ids": index.names, "text_stats": index.stats})
    if functions:
        sql_functions.register(r.spark, *functions)
    return engine


_CHUNKS = "docs AS (SELECT c.id, c.content, c.file_id, c.chunk_index, e.vector FROM chunks c LEFT JOIN chunk_vectors e ON e.id = c.id)"


def _search(name, mode, oracle, call):
    @query(
        name,
        f"WITH {_CHUNKS}, {_bm25('docs')}, v AS (SELECT id, {_COS} AS score FROM docs WHERE vector IS NOT NULL), h AS (SELECT id, score FROM {oracle} ORDER BY round(score, 9) DESC, id LIMIT 10) "
        f"SELECT h.id, d.file_id, d.chunk_index, d.content, round(h.score, 6) AS score, '{mode}' AS score_type, (SELECT min(path) FROM dentries x WHERE x.file_id = d.file_id) AS path FROM h JOIN docs d ON d.id = h.id",
        "chunks", "chunk_vectors", "dentries",
    )
    def run(r):
        engine = _indexed(r, chunk_index(r), [])
        for name, own in (("vectors_of", "chunk_vectors"), ("chunks", "chunks"), ("dentries", "dentries")):
            engine.register(name, r(own))
        # what the words mean is the model's business; here a fixed vector
        r.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION embedding(x STRING) RETURNS ARRAY<DOUBLE> RETURN array({', '.join(f'{v}D' for v in VECTOR)})")
        sql_functions.register(r.spark, "search")
        return engine.sql(f"SELECT id, file_id, chunk_index, content, round(score, 6) AS score, score_type, path FROM search({call})")


_search("sql_search_hybrid", "rrf", _rrf("v", "q", 10), f"'{WORDS}'")
_search("sql_search_semantic", "cosine", "v", f"'{WORDS}', 'semantic', 10")
_search("sql_search_fulltext", "bm25", "q", f"'{WORDS}', n => 10, mode => 'fulltext'")


@query("sql_file_functions", "SELECT p.path, true AS there, strlen(content) AS size, left(content, 5) AS head, parent_path AS parent, name FROM paths p UNION ALL SELECT p.path || 'x', false, NULL, NULL, parent_path, name || 'x' FROM paths p", "paths")
def sql_file_functions(r):
    engine = _engine(r, list(sql_functions.SCALARS), "paths", "dentries", "files_meta", "contents", "files")
    return engine.sql(
        "SELECT path, file_exists(path) AS there, file_size(path) AS size, left(file_read(path), 5) AS head, path_parent(path) AS parent, path_name(path) AS name "
        "FROM (SELECT path FROM paths UNION ALL SELECT path || 'x' FROM paths) a"
    )
