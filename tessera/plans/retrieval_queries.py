"""Queries over ranking, vectors, memories and answers."""

import uuid

from pyspark.sql import functions as F

from tessera.intermediate import shared_dir
from tessera.operators import answer, collections, embeddings, memory, retrieval, vectors
from tessera.operators import pipeline as pipe
from tessera.plans.registry import query

#: A unit-free query vector, the same in both engines.
VECTOR = [((k * 37 + 11) % 64 - 32) / 32.0 for k in range(64)]
WORDS = "the worthless thouandon"
_V = "[" + ",".join(f"{x}" for x in VECTOR) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(list_transform(vector, lambda x: CAST(x AS DOUBLE)), {_V})"


def _bm25(source: str, key: str = "id", content: str = "content", words: str = WORDS) -> str:
    """CTEs t, c, q: BM25 scores (key, score) in q."""
    terms = sorted(set(words.lower().split()))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(terms)))
    part = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for k in range(len(terms)))
    some = " OR ".join(f"tf{k} > 0" for k in range(len(terms)))
    return (
        f"t AS (SELECT {key}, len(w) AS dl, {tf} FROM (SELECT {key}, regexp_extract_all(lower({content}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source})), "
        f"c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM t), q AS (SELECT {key}, {part} AS score FROM t, c WHERE {some})"
    )


def _rank(source: str, k: int, key: str = "id") -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY round(score, 9) DESC, {key}) AS rank FROM {source} QUALIFY rank <= {k}"


def _rrf(dense: str, sparse: str, k: int, overfetch: int = 1, key: str = "id") -> str:
    """The fused list (key, score) of two scored sources."""
    n = k * overfetch
    return (
        f"(SELECT {key}, score FROM (SELECT {key}, sum(1.0 / (60 + rank)) AS score FROM ({_rank(dense, n, key)} UNION ALL {_rank(sparse, n, key)}) GROUP BY {key}) ORDER BY round(score, 9) DESC, {key} LIMIT {k})"
    )


_DOCS = "SELECT d.doc_id AS id, d.text AS content, e.embedding AS vector FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"


def chunk_index(r):
    return r.text_index("chunks", r("chunks"), "documents", keep=("file_id",))


def doc_index(r):
    return r.text_index("documents", r("documents").selectExpr("doc_id AS id", "text AS content"), "documents")


def _vectors(r):
    own = r("embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    return own.join(r("documents").selectExpr("doc_id AS id"), "id", "left_semi")


def _out(df, *extra):
    return df.select("id", F.round("score", 6).alias("score"), *extra)


@query("vector_topk", f"SELECT id, round({_COS}, 6) AS score FROM vectors ORDER BY round({_COS}, 9) DESC, id LIMIT 20", "vectors")
def vector_topk(r):
    return _out(retrieval.vector_topk(r("vectors"), VECTOR, 20))


@query("bm25_topk", f"WITH {_bm25('chunks')} SELECT id, round(score, 6) AS score FROM q ORDER BY round(score, 9) DESC, id LIMIT 25", "chunks")
def bm25_topk(r):
    return _out(retrieval.bm25_topk(None, WORDS, 25, index=chunk_index(r)))


@query("bm25_unindexed", f"WITH {_bm25('summaries_', 'id')} SELECT id, round(score, 6) AS score FROM q ORDER BY round(score, 9) DESC, id LIMIT 25".replace("WITH ", "WITH summaries_ AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents), ", 1))
def bm25_unindexed(r):
    """Without a stored index: one pass over the texts."""
    return _out(retrieval.bm25_topk(r("documents").selectExpr("CAST(doc_id AS STRING) AS id", "text AS content"), WORDS, 25))


def vector_cells(r):
    return r.vector_index("embeddings", r("embeddings").selectExpr("vec_id AS id", "embedding AS vector"), "embeddings")


_EMBEDDED = "(SELECT vec_id AS id, embedding AS vector FROM embeddings)"


@query("vector_index_topk", f"SELECT id, round({_COS}, 6) AS score FROM {_EMBEDDED} ORDER BY round({_COS}, 9) DESC, id LIMIT 50")
def vector_index_topk(r):
    """Exact by the cells' bounds."""
    return _out(vector_cells(r).topk(VECTOR, 50, exact=True))


#: Cells a query reads of the index of the embeddings, whose vectors hardly cluster.
PROBES = 32


@query("vector_index_batch")
def vector_index_batch(r):
    """Approximate neighbours of each vector whose id is divisible by 100, among all; recall is tested."""
    queries = r("embeddings").where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    return vector_cells(r).batch_topk(queries, 10, probes=PROBES).withColumn("score", F.round("score", 6))


def _han(text):
    """Latin letters of frequent words as Han characters: rows to segment."""
    return f"translate({text}, 'aehinorst', '的一是不了人我在有')"


_HAN_RE = "[\\x{4E00}-\\x{9FFF}]"
_HAN_TOKENS = (
    f"list_concat(list_concat(list_filter(list_transform(range(1, length(c)), lambda i: substring(c, i, 2)), lambda x: regexp_full_match(x, '{_HAN_RE}{{2}}')), "
    f"list_transform(list_filter(list_transform(range(1, length(c) + 1), lambda i: substring(' ' || c || ' ', i, 3)), lambda x: regexp_full_match(x, '[^\\x{{4E00}}-\\x{{9FFF}}]{_HAN_RE}[^\\x{{4E00}}-\\x{{9FFF}}]', 's')), lambda x: substring(x, 2, 1))), "
    f"regexp_extract_all(regexp_replace(c, '{_HAN_RE}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'))"
)
_HAN_QUERY = "在不一 d 了"


@query(
    "bm25_han",
    f"WITH h AS (SELECT id, lower({_han('content')}) AS c FROM chunks), w AS (SELECT id, {_HAN_TOKENS} AS w FROM h), "
    "t AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = '在不')) AS tf0, len(list_filter(w, lambda x: x = '不一')) AS tf1, len(list_filter(w, lambda x: x = 'd')) AS tf2, len(list_filter(w, lambda x: x = '了')) AS tf3 FROM w), "
    f"c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE tf{k} > 0) AS df{k}' for k in range(4))} FROM t), "
    f"q AS (SELECT id, {' + '.join(f'ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))' for k in range(4))} AS score FROM t, c WHERE tf0 + tf1 + tf2 + tf3 > 0) "
    "SELECT id, round(score, 6) AS score FROM q ORDER BY round(score, 9) DESC, id LIMIT 25",
    "chunks",
)
def bm25_han(r):
    """Full text over Han runs cut to overlapping pairs."""
    docs = r("chunks").select("id", F.expr(_han("content")).alias("content"))
    return _out(retrieval.bm25_topk(None, _HAN_QUERY, 25, index=r.text_index("han", docs, "documents", tokeniser="bigrams")))


_HYBRID = f"WITH docs AS ({_DOCS}), {_bm25('docs')}, v AS (SELECT id, {_COS} AS score FROM docs WHERE vector IS NOT NULL)"


@query("search_hybrid", f"{_HYBRID} SELECT id, round(score, 6) AS score, 'rrf' AS score_type FROM {_rrf('v', 'q', 10)}")
def search_hybrid(r):
    return _out(retrieval.search(_vectors(r), WORDS, VECTOR, index=doc_index(r)), "score_type")


def _mode(name, mode, oracle):
    @query(name, f"{_HYBRID} SELECT id, round(score, 6) AS score, '{'cosine' if mode == 'semantic' else 'bm25'}' AS score_type FROM {oracle} ORDER BY round(score, 9) DESC, id LIMIT 10")
    def run(r):
        index = None if mode == "semantic" else doc_index(r)  # vectors alone are ranked
        return _out(retrieval.search(_vectors(r), WORDS, VECTOR, mode, limit=0, index=index), "score_type")


# a limit of 0 is the default of ten; one over a hundred is a hundred
_mode("search_semantic", "semantic", "v")
_mode("search_fulltext", "fulltext", "q")


@query("search_clamped", f"{_HYBRID} SELECT id, round(score, 6) AS score FROM v ORDER BY round(score, 9) DESC, id LIMIT 100")
def search_clamped(r):
    return _out(retrieval.search(_vectors(r), WORDS, VECTOR, "semantic", limit=5000))


@query("hybrid_rrf", f"{_HYBRID} SELECT h.id, round(score, 6) AS score, p.path FROM {_rrf('v', 'q', 10, 5)} h JOIN paths p ON p.doc_id = h.id", "paths")
def hybrid_rrf(r):
    hits = retrieval.search(_vectors(r), WORDS, VECTOR, limit=10, overfetch=5, index=doc_index(r))
    return hits.join(r("paths").select(F.col("doc_id").alias("id"), "path"), "id").select("id", F.round("score", 6).alias("score"), "path")


@query("search_scoped", f"WITH s AS (SELECT * FROM chunks WHERE file_id IN (SELECT file_id FROM dentries WHERE path LIKE '/src1/%')), {_bm25('s')} SELECT id, round(score, 6) AS score FROM q ORDER BY round(score, 9) DESC, id LIMIT 10", "chunks", "dentries")
def search_scoped(r):
    index = chunk_index(r)
    return _out(retrieval.bm25_topk(None, WORDS, 10, index=index, scope=retrieval.in_scope(index.places, r("dentries"), "src1/")))


@query("alias_resolve", "SELECT file_id, (SELECT min(path) FROM dentries d WHERE d.file_id = m.file_id) AS path FROM files_meta m WHERE ref_count > 1 UNION ALL SELECT id, path FROM dentries WHERE is_dir", "files_meta", "dentries")
def alias_resolve(r):
    hits = r("files_meta").where("ref_count > 1").select("file_id").union(r("dentries").where("is_dir").select("id"))
    return retrieval.alias_resolve(hits, r("dentries")).select("file_id", "path")


_SUMMARY_TOP = f"SELECT id, {_COS} AS score FROM summary_vectors ORDER BY round({_COS}, 9) DESC, id LIMIT"
_OF_SUMMARY = "(SELECT min({0}) FROM summaries x WHERE coalesce(x.file_id, x.dentry_id) = h.id) AS {0}"


@query("summary_topk", f"SELECT id, round(score, 6) AS score FROM ({_SUMMARY_TOP} 10)", "summary_vectors")
def summary_topk(r):
    return _out(retrieval.summary_topk(r("summary_vectors"), VECTOR))


def _level(name, level, limit, *columns):
    @query(name, f"SELECT id, round(score, 6) AS score, 'cosine' AS score_type, {', '.join(_OF_SUMMARY.format(c) for c in columns)} FROM ({_SUMMARY_TOP} {limit}) h", "summary_vectors", "summaries")
    def run(r):
        return _out(retrieval.detailed(r("chunks"), r("summaries"), r("summary_vectors"), WORDS, VECTOR, level, "fulltext", limit), "score_type", *columns)


_level("search_abstract", "abstract", 15, "l0_abstract")
_level("search_overview", "overview", 10, "l0_abstract", "l1_overview")


@query("min_score", f"SELECT id, score FROM (SELECT id, round({_COS}, 6) AS score, {_COS} AS exact FROM vectors ORDER BY round({_COS}, 9) DESC, id LIMIT 30) WHERE exact >= 0.2", "vectors")
def min_score(r):
    return _out(retrieval.with_min_score(retrieval.vector_topk(r("vectors"), VECTOR, 30), 0.2, "semantic"))


_ACTIVE = "status = 'active'"
_NUM = "CAST(json_extract(meta, '$.price') AS DOUBLE)"


def _filtered(name, spec, condition):
    @query(name, f"SELECT pk, meta FROM vectors WHERE {_ACTIVE} AND {condition}", "vectors")
    def run(r):
        return vectors.scoped(r("vectors"), None, spec).select("pk", "meta")


_filtered("meta_filter_eq", {"must": [{"field": "meta.brand", "op": "eq", "value": "b1"}]}, "json_extract_string(meta, '$.brand') = 'b1'")
_filtered("meta_filter_bool", {"must": [{"field": "meta.hot", "op": "eq", "value": True}]}, "json_extract_string(meta, '$.hot') = 'true'")
_filtered("meta_filter_range", {"must": [{"field": "meta.price", "op": "gte", "value": 50}, {"field": "meta.price", "op": "lt", "value": 120.5}]}, f"{_NUM} >= 50 AND {_NUM} < 120.5")
_filtered("meta_filter_in", {"must": [{"field": "meta.brand", "op": "in", "value": ["b0", "b3", 7]}]}, "json_extract_string(meta, '$.brand') IN ('b0', 'b3')")


@query("tag_filter", "SELECT pk FROM vectors WHERE category = 'c3' AND list_contains(tags, 't1')", "vectors")
def tag_filter(r):
    from tessera.functions.records import tag_filter as condition

    return r("vectors").where(condition(F.col("category"), F.col("tags"), "c3", ["t1"])).select("pk")


_TEXTED = "SELECT v.*, coalesce(d.text, '') AS text FROM vectors v LEFT JOIN documents d ON v.vec_id = d.doc_id"


def _texts(r):
    d = r("documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return r("vectors").select("vec_id", F.col("pk").alias("id")).join(d, "vec_id", "left").select("id", "content")


@query("vector_hybrid_filtered", f"WITH rows_ AS (SELECT pk AS id, category, vector, text AS content FROM ({_TEXTED}) WHERE {_ACTIVE} AND dataset = 'ds1' AND {_NUM} < 200), {_bm25('rows_')}, v AS (SELECT id, {_COS} AS score FROM rows_) SELECT h.id, round(h.score, 6) AS score, r.category FROM {_rrf('v', 'q', 10, 5)} h JOIN rows_ r ON r.id = h.id", "vectors")
def vector_hybrid_filtered(r):
    spec = {"must": [{"field": "meta.price", "op": "lt", "value": 200}]}
    index = r.text_index("vector-texts", _texts(r), "documents", "embeddings")
    return _out(vectors.search(r("vectors"), WORDS, VECTOR, "ds1", spec=spec, output_fields=["category"], index=index), "category")


@query("vector_projection", "SELECT pk, category, meta FROM vectors WHERE status = 'active' AND vec_id IN (1, 2, 3, 4)", "vectors")
def vector_projection(r):
    return vectors.query_ids(r("vectors"), ["ds1:v1", "ds2:v2", "ds0:v3", "ds1:v4", "ds0:v4"], ["category", "meta"])


@query("vector_query_ids", "SELECT pk FROM vectors WHERE pk IN ('ds1:v1', 'ds0:v9', 'ds0:v12') AND status = 'active'", "vectors")
def vector_query_ids(r):
    return vectors.query_ids(r("vectors"), ["ds1:v1", "ds0:v9", "ds0:v12", "ds0:v1"], [])


@query("dataset_canonical", "SELECT w.name, d.dataset AS canonical FROM (SELECT DISTINCT upper(dataset) AS name FROM vectors UNION ALL SELECT 'none') w LEFT JOIN (SELECT DISTINCT dataset FROM vectors) d ON upper(d.dataset) = w.name", "vectors")
def dataset_canonical(r):
    wanted = r("vectors").select(F.upper("dataset").alias("name")).distinct().union(r("region").sparkSession.range(1).select(F.lit("none")))
    return vectors.canonical_dataset(r("vectors"), wanted)


@query("vector_count", "SELECT dataset, count(*) AS n FROM vectors WHERE status = 'active' GROUP BY dataset", "vectors")
def vector_count(r):
    return vectors.vector_count(r("vectors"))


@query("collection_search", f"SELECT id, category, round({_COS}, 6) AS score FROM vectors WHERE dataset = 'ds0' ORDER BY round({_COS}, 9) DESC, id LIMIT 7", "vectors")
def collection_search(r):
    hits = collections.collection_search(r("vectors").where("dataset = 'ds0'").select("id", "category", "vector"), VECTOR, 7)
    return hits.withColumn("score", F.round("score", 6))


@query("impressions", "SELECT DISTINCT e.user_id AS query_id, 'f' || (e.event_id % 400) AS dentry_id FROM events e WHERE e.event_id % 3 <> 0")
def impressions(r):
    hits = r("events").selectExpr("user_id AS query_id", "CASE WHEN event_id % 3 <> 0 THEN 'f' || (event_id % 400) END AS dentry_id", "event_id % 3 = 0 AS is_dir")
    return retrieval.impressions(hits)


def _trimmed(column):
    """DuckDB's text for a value trimmed of all white space."""
    space = "[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
    return f"regexp_replace({column}, '\\A{space}+|{space}+\\z', '', 'g')"


def _normal(column):
    return f"nfc_normalize({_trimmed(column)})"


@query("embed_dictionary", f"SELECT sha256('m:' || t) AS cache_key, t AS text FROM (SELECT DISTINCT {_normal('content')} AS t FROM chunks) WHERE t <> '' AND t NOT IN (SELECT {_normal('content')} FROM chunks WHERE chunk_index = 0)", "chunks")
def embed_dictionary(r):
    c = r("chunks")
    known = vectors.embed_dictionary(c.where("chunk_index = 0").select(F.col("content").alias("text")), r.spark.createDataFrame([], "cache_key string"), "m")
    return vectors.embed_dictionary(c.select(F.col("content").alias("text")), known, "m")


@query("embed_cached", f"SELECT id, file_id IN (SELECT file_id FROM chunks WHERE {_normal('content')} <> '') AND {_normal('content')} IN (SELECT {_normal('content')} FROM chunks WHERE chunk_index = 0) AND {_normal('content')} <> '' AS hit, {_normal('content')} <> '' AS has_vector FROM chunks", "chunks")
def embed_cached(r):
    """First chunks, then all of them an hour later: the dictionary knows what was embedded before."""
    folder = f"{shared_dir(r.spark)}/tessera/embeddings-{uuid.uuid4().hex}"
    own = r("chunks").select("id", F.col("content").alias("text"), "chunk_index")
    embeddings.cached(own.where("chunk_index = 0"), folder, "2024-01-01 00:00:00", "m", entries=10_000_000)
    found = embeddings.cached(own, folder, "2024-01-01 00:59:00", "m", entries=10_000_000)
    return found.select("id", "hit", F.col("vector").isNotNull().alias("has_vector"))


@query("embedding_json")
def embedding_json(r):
    return r("region").select("r_name", F.to_json(vectors.embedding_column()(F.col("r_name"))).alias("embedding"))


# memories
ACTOR = memory.Actor("w1", "p1", "d2")
_SCOPE = "((scope_type = 'workspace' AND scope_id = 'w1') OR (scope_type = 'principal' AND scope_id = 'p1' AND (origin_workspace_id IS NULL OR origin_workspace_id = 'w1')) OR (scope_type = 'dept' AND scope_id = 'd2'))"
_NOW = "2024-01-03 00:00:00"
_LIVE = f"(expires_at IS NULL OR expires_at > TIMESTAMP '{_NOW}')"


@query("memory_scope", f"SELECT id, scope_type FROM memories WHERE {_SCOPE}", "memories")
def memory_scope(r):
    return r("memories").where(memory.in_context(ACTOR)).select("id", "scope_type")


@query("memory_live", f"SELECT id, topic FROM memories WHERE {_LIVE} AND topic IS NULL AND kind = 'preference'", "memories")
def memory_live(r):
    return r("memories").where(memory.live(_NOW, "", "preference")).select("id", "topic")


@query("topic_counts", "SELECT topic, count(*) AS n FROM memories GROUP BY topic", "memories")
def topic_counts(r):
    return memory.topic_counts(r("memories"))


def _candidates(r):
    return r("memories").selectExpr("id", "CAST(-id AS BIGINT) AS rank")


@query("memory_recheck", f"SELECT m.id, c.rank FROM (SELECT id, -id AS rank FROM memories) c JOIN memories m ON m.id = c.id WHERE {_SCOPE} AND {_LIVE}", "memories")
def memory_recheck(r):
    return memory.recheck(_candidates(r), r("memories"), memory.in_context(ACTOR) & memory.live(_NOW)).select("id", "rank")


_W = "CASE scope_type WHEN 'workspace' THEN 3 WHEN 'dept' THEN 2 ELSE 1 END"


@query("memory_dedup", f"SELECT id, first_rank AS rank FROM (SELECT id, row_number() OVER (PARTITION BY h ORDER BY {_W} DESC, rank, id) AS b, min(rank) OVER (PARTITION BY h) AS first_rank FROM (SELECT id, scope_type, left(content_hash, 1) AS h, -id AS rank FROM memories)) WHERE b = 1 ORDER BY first_rank, id LIMIT 10", "memories")
def memory_dedup(r):
    rows = _candidates(r).join(r("memories"), "id").withColumn("content_hash", F.left("content_hash", F.lit(1)))
    return memory.dedup(rows, 10).select("id", "rank")


_MEMORIES = f"SELECT m.*, e.embedding AS vector FROM memories m LEFT JOIN embeddings e ON m.id % 977 = e.vec_id"


@query(
    "memory_search",
    f"WITH mv AS (SELECT * FROM ({_MEMORIES}) WHERE {_SCOPE}), {_bm25('mv')}, v AS (SELECT id, {_COS} AS score FROM mv WHERE vector IS NOT NULL), "
    f"h AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM {_rrf('v', 'q', 30, 5)}), "
    f"a AS (SELECT h.id, h.rank, m.content_hash, {_W} AS w FROM h JOIN memories m ON m.id = h.id WHERE {_SCOPE} AND {_LIVE}) "
    "SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY content_hash ORDER BY w DESC, rank, id) AS b, min(rank) OVER (PARTITION BY content_hash) AS rank FROM a) WHERE b = 1 ORDER BY rank, id LIMIT 10",
    "memories",
)
def memory_search(r):
    """Scope, hybrid candidates, re-check, collapse of equal contents."""
    m, e = r("memories"), r("embeddings")
    rows = m.join(e, m["id"] % 977 == e["vec_id"], "left").select(m["*"], F.col("embedding").alias("vector"))
    index = r.text_index("memories", m.select("id", "content"), "conversations")
    return memory.search(rows, ACTOR, WORDS, VECTOR, _NOW, index=index).select("id", "rank")


@query("memory_save_dedup", "SELECT scope_type, scope_id, content_hash, min(id) AS id FROM (SELECT id, scope_type, scope_id, sha256(_TRIM_) AS content_hash FROM memories WHERE length(_TRIM_) BETWEEN 1 AND 4096) WHERE (scope_type, scope_id, content_hash) NOT IN (SELECT (scope_type, scope_id, content_hash) FROM memories WHERE id % 2 = 0) GROUP BY ALL".replace("_TRIM_", _trimmed("content")), "memories")
def memory_save_dedup(r):
    m = r("memories")
    return memory.save(m.where("id % 2 = 0"), m.drop("content_hash")).select("scope_type", "scope_id", "content_hash", "id")


@query("memory_topic", "SELECT new_id, CASE WHEN score >= 0.75 THEN topic END AS topic FROM (SELECT id // 100 AS new_id, topic, (id % 7) / 7.0 AS score, row_number() OVER (PARTITION BY id // 100 ORDER BY (id % 7) / 7.0 DESC, id) AS rn FROM memories) WHERE rn = 1", "memories")
def memory_topic(r):
    near = r("memories").selectExpr("id div 100 AS new_id", "id", "(id % 7) / 7.0D AS score", "topic")
    return memory.inherited_topic(near)


@query("memory_origin", "SELECT id, CASE WHEN scope_type IN ('workspace', 'dept') OR given = '' THEN NULL WHEN given IS NOT NULL THEN given WHEN kind = 'preference' THEN NULL ELSE 'w9' END AS origin FROM (SELECT *, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'w5' END AS given FROM memories)", "memories")
def memory_origin(r):
    given = F.expr("CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'w5' END")
    return r("memories").select("id", memory.origin(F.col("scope_type"), F.col("kind"), given, "w9").alias("origin"))


@query("memory_update", "SELECT id, CASE WHEN id = 900 THEN 'new text' ELSE content END AS content FROM memories", "memories")
def memory_update(r):
    return memory.update(r("memories"), memory.Actor("w1", "p0"), 900, " new text ").select("id", "content")


@query("memory_touch", "SELECT id, CASE WHEN id IN (100, 201, 302) THEN TIMESTAMP '2024-01-03 00:00:00' END AS last_used_at FROM memories", "memories")
def memory_touch(r):
    return memory.touch(r("memories"), [100, 201, 302], _NOW).select("id", "last_used_at")


@query("profile_fresh", "SELECT id, profile_at >= TIMESTAMP '2024-01-04' AS fresh FROM principals", "principals")
def profile_fresh(r):
    return memory.fresh_profiles(r("principals"), "2024-01-05 00:00:00").select("id", "fresh")


# answers
@query("citations", "SELECT doc_id, list_transform(regexp_extract_all(x, '\\[(\\d{1,9})\\]', 1), lambda s: CAST(s AS INT)) AS found FROM (SELECT doc_id, '[' || doc_id || '] and [12][a] [' || (doc_id % 3) || '] [3' AS x FROM documents)")
def citations(r):
    from tessera.functions.text import citation_indices

    x = F.expr("'[' || doc_id || '] and [12][a] [' || (doc_id % 3) || '] [3'")
    return r("documents").select("doc_id", citation_indices(x).alias("found"))


_HITS = "SELECT conv_id AS answer_id, turn AS seq, CASE WHEN turn % 4 <> 3 THEN '/p' || (turn % 2) END AS path, CASE WHEN turn % 4 <> 3 AND turn % 3 > 0 THEN CAST(turn % 3 AS INT) END AS chunk_index, CASE WHEN turn % 4 = 3 THEN conv_id END AS memory_id, text AS content FROM conversations"


def _hits(r):
    return r("conversations").selectExpr("conv_id AS answer_id", "turn AS seq", "CASE WHEN turn % 4 <> 3 THEN '/p' || (turn % 2) END AS path", "CASE WHEN turn % 4 <> 3 AND turn % 3 > 0 THEN CAST(turn % 3 AS INT) END AS chunk_index", "CASE WHEN turn % 4 = 3 THEN conv_id END AS memory_id", "text AS content")


_KEYED = f"SELECT *, CASE WHEN memory_id IS NOT NULL THEN 'm' || memory_id ELSE concat_ws('|', 'f', path, chunk_index) END AS k FROM ({_HITS})"
_FIRST = f"SELECT *, min(CASE WHEN memory_id IS NULL THEN 1000 ELSE 0 END + seq) OVER (PARTITION BY answer_id, k) AS f, CASE WHEN memory_id IS NULL THEN 1000 ELSE 0 END + seq AS o FROM ({_KEYED})"
_BLOCKS = f"SELECT answer_id, seq, path, chunk_index, memory_id, content, CAST(dense_rank() OVER (PARTITION BY answer_id ORDER BY f) AS INT) AS number, o = f AS is_new FROM ({_FIRST})"


@query("evidence_blocks", f"SELECT answer_id, seq, path, chunk_index, memory_id, number, is_new FROM ({_BLOCKS})")
def evidence_blocks(r):
    return answer.evidence_blocks(_hits(r))


@query("render_hits", f"SELECT answer_id, seq, '[' || number || '] ' || path || ' (chunk ' || chunk_index || ')' || CASE WHEN is_new THEN ' <<<' || CASE WHEN length(content) > 600 THEN left(content, 600) || '…' ELSE content END || '>>>' ELSE ' (as before)' END AS line FROM ({_BLOCKS}) WHERE path IS NOT NULL AND chunk_index IS NOT NULL")
def render_hits(r):
    blocks = answer.evidence_blocks(_hits(r)).where("path is not null and chunk_index is not null")
    return answer.render_hits(blocks.join(_hits(r).select("answer_id", "seq", "content"), ["answer_id", "seq"]))


@query("citation_align", "SELECT doc_id AS answer_id, CASE doc_id % 5 WHEN 0 THEN [3, 1] WHEN 1 THEN [1, 3] WHEN 2 THEN [2, 3, 1] WHEN 3 THEN [3, 1] ELSE [4, 3, 1] END AS c, true AS grounded FROM documents")
def citation_align(r):
    rows = r("documents").selectExpr("doc_id AS answer_id", "'see [' || (doc_id % 5) || '], [3] [9] [1] [3]' AS answer", "4 AS n_blocks")
    return answer.align_citations(rows).withColumnRenamed("citations", "c")


# text pipeline
@query("semantic_chunks")
def semantic_chunks(r):
    return pipe.semantic_chunks(r("contents"), 128)


@query("semantic_windows", "SELECT doc_id AS file_id, CAST(k AS INT) AS chunk_index, substring(t, CAST(k * 103 + 1 AS INT), 128) AS content FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(ceil((length(t) - 128) / 103.0), 0) AS INT) + 1)) AS k FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t FROM documents) WHERE t <> '')")
def semantic_windows(r):
    """ASCII text without headings: windows of 128 characters, 103 apart."""
    files = r("documents").select(F.col("doc_id").cast("string").alias("file_id"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("content"))
    return pipe.semantic_chunks(files, 32)


@query("storage_chunks")
def storage_chunks(r):
    return pipe.storage_chunks(r("contents"), 1024)


@query("embed_backlog", "SELECT file_id, checksum FROM files_meta WHERE ref_count = 1 OR line_count % 2 = 1", "files_meta")
def embed_backlog(r):
    m = r("files_meta")
    marks = m.where("ref_count > 1").selectExpr("file_id", "CASE WHEN line_count % 2 = 0 THEN checksum ELSE 'old' END AS checksum")
    return pipe.embed_backlog(m, marks)


@query("fresh_extract", "SELECT p.file_id, content FROM (SELECT DISTINCT file_id, content FROM paths) p WHERE strlen(content) % 2 = 0", "paths")
def fresh_extract(r):
    extracts = r("contents").selectExpr("file_id", "content", "CASE WHEN octet_length(content) % 2 = 0 THEN file_id ELSE 'stale' END AS source_sha256")
    return pipe.fresh_extract(r("files_meta"), extracts)


@query("file_summary", "SELECT file_id, left(trim(content), 120) AS l0_abstract, left(trim(content), 600) AS l1_overview FROM (SELECT file_id, CASE WHEN length(content) > 12000 THEN left(content, 6000) || chr(10) || chr(10) || '[... content truncated ...]' || chr(10) || chr(10) || right(content, 6000) ELSE content END AS content FROM contents)", "contents")
def file_summary(r):
    return pipe.file_summaries(r("contents"))


@query("child_summaries", "SELECT d.path, s.l0_abstract FROM dentries d JOIN summaries s ON d.file_id = s.file_id WHERE d.parent_path = '/src1' UNION ALL SELECT d.path, s.l0_abstract FROM dentries d JOIN summaries s ON d.id = s.dentry_id WHERE d.parent_path = '/src1'", "dentries", "summaries")
def child_summaries(r):
    return pipe.child_summaries(r("dentries"), r("summaries"), "/src1")


_KIDS = "SELECT d.parent_path, '[' || row_number() OVER (PARTITION BY d.parent_path ORDER BY d.path) || ']. ' || s.l0_abstract AS line, row_number() OVER (PARTITION BY d.parent_path ORDER BY d.path) AS n FROM dentries d JOIN summaries s ON d.file_id = s.file_id"


@query("dir_rollup", f"SELECT parent_path, CASE WHEN length(t) > 2000 THEN left(t, 1000) || chr(10) || chr(10) || '[... content truncated ...]' || chr(10) || chr(10) || right(t, 1000) ELSE t END AS text FROM (SELECT parent_path, string_agg(line, chr(10) ORDER BY n) AS t FROM ({_KIDS}) GROUP BY parent_path)", "dentries", "summaries")
def dir_rollup(r):
    return pipe.dir_rollup(pipe.child_rows(r("dentries"), r("summaries")), 2000)


# files of odd ids also stand beside their directory, so that directories hold both kinds
_MIXED = "SELECT id, CASE WHEN is_dir OR TRY_CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN parent_path ELSE regexp_extract(parent_path, '^(.*)/[^/]*$', 1) END AS parent_path, CASE WHEN is_dir OR TRY_CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN path ELSE regexp_extract(parent_path, '^(.*)/[^/]*$', 1) || '/' || name END AS path, file_id, is_dir FROM dentries"


def _rolled(kids: str) -> str:
    """Roll-ups (parent_path, text) of rows (parent_path, path, l0_abstract)."""
    return (
        "SELECT parent_path, CASE WHEN length(t) > 2000 THEN left(t, 1000) || chr(10) || chr(10) || '[... content truncated ...]' || chr(10) || chr(10) || right(t, 1000) ELSE t END AS text FROM "
        f"(SELECT parent_path, string_agg('[' || n || ']. ' || l0_abstract, chr(10) ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY path) AS n FROM ({kids})) GROUP BY parent_path)"
    )


_UP = "SELECT d.parent_path, d.path, left({0}.text, 120) AS l0_abstract FROM {0} JOIN dentries d ON d.is_dir AND d.path = {0}.parent_path"


@query(
    "rollup_levels",
    f"WITH mixed AS ({_MIXED}), fk AS (SELECT m.parent_path, m.path, s.l0_abstract, length(m.parent_path) - length(replace(m.parent_path, '/', '')) AS depth FROM mixed m JOIN summaries s ON m.file_id = s.file_id WHERE NOT m.is_dir), "
    f"r2 AS ({_rolled('SELECT parent_path, path, l0_abstract FROM fk WHERE depth = 2')}), "
    f"r1 AS ({_rolled('SELECT parent_path, path, l0_abstract FROM fk WHERE depth = 1 UNION ALL ' + _UP.format('r2'))}), "
    f"r0 AS ({_rolled(_UP.format('r1'))}) SELECT * FROM r2 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r0",
    "dentries",
    "summaries",
)
def rollup_levels(r):
    mixed = r("dentries").selectExpr(
        "id", "is_dir", "file_id", "is_dir OR CAST(CASE WHEN NOT is_dir THEN substr(id, 2) END AS BIGINT) % 2 = 0 AS stays", "parent_path", "path", "name", "regexp_extract(parent_path, '^(.*)/[^/]*$', 1) AS up"
    ).selectExpr("id", "is_dir", "file_id", "CASE WHEN stays THEN parent_path ELSE up END AS parent_path", "CASE WHEN stays THEN path ELSE up || '/' || name END AS path")
    return pipe.rollup_levels(mixed, r("summaries"), 2000)
