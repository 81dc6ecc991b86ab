import hashlib
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.errors import Conflict, InvalidInput, NotFound, QuotaExceeded
from tessera.intermediate import setting
from tessera.operators import answer, fs, memory, mutations, pipeline, retrieval, segments, snapshots, state, vectors
from tessera.plans.catalog import QUERIES
from tessera.sources import fixtures, formats, word


def files(spark, **contents):
    return spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content string")


def test_csv(spark):
    df = formats.csv_rows(spark.createDataFrame([("/u.csv", "name,age\nAlice,30\nBob,25\n")], "path string, content string"))
    assert [tuple(r) for r in df.orderBy("_line_number").collect()] == [(1, "Alice", 30, "/u.csv"), (2, "Bob", 25, "/u.csv")]


def test_glob_of_mixed_formats(spark):
    df = spark.createDataFrame([("/l/a.txt", "1\n2\n"), ("/l/b.txt", "3"), ("/l/c.csv", "x\n1")], "path string, content string")
    assert formats.read_glob(df, "/l/*.txt").count() == 3
    assert formats.read_glob(df, "/none/*").count() == 0
    with pytest.raises(InvalidInput):
        formats.read_glob(df, "/l/*")
    with pytest.raises(QuotaExceeded):
        formats.check_budget(df, file_bytes=2)


def test_read_path(spark, sf):
    d, c = fixtures.relation(spark, sf, "dentries"), fixtures.relation(spark, sf, "contents")
    assert formats.read_path(d, c, "/src1/").count() > 0
    for missing in ("/nope.txt", "/nope/"):
        with pytest.raises(NotFound):
            formats.read_path(d, c, missing)


def test_guard(spark):
    with pytest.raises(QuotaExceeded):
        fs.guarded(spark.range(5), 4)
    assert fs.guarded(spark.range(5), 5).count() == 5


def test_lookup_of_null_and_root(spark, sf):
    asked = spark.createDataFrame([(None,), ("/",), ("/gone",)], "path string")
    got = {r["path"]: r["exists_"] for r in fs.lookup(asked, fixtures.relation(spark, sf, "dentries"), fixtures.relation(spark, sf, "files_meta")).collect()}
    assert got == {None: None, "/": True, "/gone": False}


def test_last_wins(spark):
    df = spark.createDataFrame([(0, "A", 1), (1, "B", 2), (2, "A", 3)], "pos int, id string, v int")
    assert sorted(tuple(r) for r in mutations.last_wins(df).select("pos", "id", "v").collect()) == [(0, "A", 3), (1, "B", 2)]
    again = mutations.upsert(mutations.last_wins(df).drop("pos"), df, "id")
    assert sorted(tuple(r) for r in again.select("id", "v").collect()) == [("A", 3), ("B", 2)]


def test_drift_heals(spark):
    a, b = spark.createDataFrame([("x",)], "file_id string"), spark.createDataFrame([("x",), ("y",)], "file_id string")
    missing, orphan = state.drift(a, b)
    assert [r[0] for r in missing.collect()] == ["y"] and orphan.count() == 0
    assert state.drift(a.union(missing), b)[0].count() == 0


def test_rrf(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = [(r["id"], round(r["score"], 6)) for r in retrieval.fuse([one, two], 10).orderBy("score", ascending=False).collect()]
    assert got == [("b", round(1 / 61 + 1 / 62, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 62, 6))]


def test_search_modes(spark):
    docs = spark.createDataFrame([("a", "x y", [1.0, 0.0]), ("b", "y z", [0.0, 1.0]), ("c", "q", None)], "id string, content string, vector array<float>")
    assert [r.id for r in retrieval.search(docs, "z", None, "fulltext").collect()] == ["b"]
    assert [r.id for r in retrieval.search(docs, "", [1.0, 0.0], "semantic", 1).collect()] == ["a"]
    assert retrieval.search(docs, "!!", None, "fulltext").count() == 0
    with pytest.raises(InvalidInput):
        retrieval.search(docs, "z", None, "hybrid")
    with pytest.raises(InvalidInput):
        retrieval.search(docs, "z", None, "other")
    with pytest.raises(InvalidInput):
        retrieval.with_min_score(docs, 0.5, "hybrid")
    with pytest.raises(QuotaExceeded):
        vectors.search(docs, "z", [1.0], top_k=101)


def test_plans_push_filters_down(spark, sf):
    plan = spark.read.parquet(f"{sf}/part.parquet").where("p_size > 10").select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)]" in plan


def test_topk_is_a_heap(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<float>")
    plan = retrieval.vector_topk(docs, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_memory_scopes(spark):
    rows = [(1, "workspace", "w", None), (2, "principal", "p", None), (3, "principal", "p", "w2"), (4, "dept", "d", None), (5, "principal", "q", None)]
    df = spark.createDataFrame(rows, "id int, scope_type string, scope_id string, origin_workspace_id string")
    ids = lambda actor: {r.id for r in df.where(memory.in_context(actor)).collect()}
    assert ids(memory.Actor("w", "p", "d")) == {1, 2, 4}
    assert ids(memory.Actor("w", "p", "d", team_only=True)) == {1}


def test_citation_alignment(spark):
    df = spark.createDataFrame([(1, "see [2] [9] [2] [1]", 3), (2, "none", 3), (3, answer.REFUSAL, 3)], "answer_id int, answer string, n_blocks int")
    got = {r.answer_id: (r.citations, r.grounded) for r in answer.align_citations(df).collect()}
    assert got == {1: ([2, 1], True), 2: ([], False), 3: ([], True)}


def test_tool_loop():
    def model(history, force_answer):
        return {"answer": "done"} if force_answer or len(history) > 2 else {"calls": [("echo", {"x": 1})]}

    assert answer.tool_loop("q", model, {"echo": lambda x: x}) == ("done", 3)
    assert answer.tool_loop("q", lambda h, force_answer: {"calls": [("no", {})]}, {})[0] == answer.REFUSAL


def test_chunk_golden():
    assert pipeline.semantic_chunk("") == []
    assert len(pipeline.semantic_chunk("x" * 300, 32)[0]) == 128
    assert pipeline.semantic_chunk("intro\n# A\nb\n  ## C\nd\n####### no", 64) == ["intro", "# A\nb", "  ## C\nd\n####### no"]
    assert all(len(c) <= 64 for c in pipeline.semantic_chunk("知" * 2000, 64))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab知\n# ", max_size=400), st.integers(8, 40))
def test_chunks_cover_and_fit(value, tokens):
    for section in pipeline.sections(value):
        at = 0
        for w in pipeline.windows(section, tokens * 4, max(tokens * 4 // 5, 16)):
            assert sum(1 if ord(c) < 128 else 4 for c in w) <= max(tokens * 4, 4)
            start = section.find(w, max(at - len(w), 0))
            assert 0 <= start <= at
            at = max(at, start + len(w))
        assert at == len(section)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\né", max_size=200), st.integers(1, 20))
def test_storage_chunks_join_back(value, size):
    parts = pipeline.storage_chunk(value, size)
    assert "".join(p[4] for p in parts) == value
    assert all(p[4].endswith("\n") for p in parts[:-1])
    assert [p[0] for p in parts] == [1 + sum(q[1] for q in parts[:k]) for k in range(len(parts))]


def test_trims_and_composes_as_the_service_does(spark):
    odd = ["\t note \n", "　note ", "note", "café", " café ", " \t ", "", None, "x" * 5000]
    texts = spark.createDataFrame([(t,) for t in odd], "text string")
    got = {r.text: r.cache_key for r in vectors.embed_dictionary(texts, spark.createDataFrame([], "cache_key string"), "m").collect()}
    assert got == {t: hashlib.sha256(f"m:{t}".encode()).hexdigest() for t in ("note", "café")}
    known = spark.createDataFrame([(got["note"],)], "cache_key string")
    assert [r.text for r in vectors.embed_dictionary(texts, known, "m").collect()] == ["café"]
    rows = spark.createDataFrame([(1, "workspace", "w", "\n a\t", None), (2, "workspace", "w", "a", None), (3, "workspace", "w", " ", None)], "id long, scope_type string, scope_id string, content string, topic string")
    none = spark.createDataFrame([], "scope_type string, scope_id string, content_hash string")
    assert [(r.id, r.content) for r in memory.save(none, rows).collect()] == [(1, "a")]
    actor = memory.Actor("w", "p")
    assert memory.update(rows, actor, 2, "\t b　\n").where("id = 2").first().content == "b"
    lines = spark.createDataFrame([("/a.jsonl", '\t{"k": 1} \n \t\n{"k": 2}\nno')], "path string, content string")
    assert [(r._line_number, r.line) for r in formats.jsonl_lines(lines).orderBy("_line_number").collect()] == [(1, '{"k": 1}'), (3, '{"k": 2}')]


def test_quoted_fields_hold_line_ends(spark):
    content = 'a,b\n1,"x\ny"\n\n2,"he said ""no"""\n3,z'
    rows = formats.csv_rows(spark.createDataFrame([("/t.csv", content)], "path string, content string"), schema="a long, b string").orderBy("_line_number").collect()
    assert [(r._line_number, r.a, r.b) for r in rows] == [(1, 1, "x\ny"), (2, 2, 'he said "no"'), (3, 3, "z")]


def test_rollup_of_a_deep_and_mixed_tree(spark):
    dirs = ["/" + "/".join(f"d{k}" for k in range(n)) for n in range(1, 13)]
    up = lambda p: p.rsplit("/", 1)[0] or "/"
    rows = [("d" + p, up(p), p, None, True) for p in dirs] + [("f1", dirs[-1], dirs[-1] + "/leaf", "leaf", False), ("f2", "/d0", "/d0/a", "a", False), ("f3", "/d0", "/d0/z", "z", False), ("dx", "/", "/empty", None, True)]
    dentries = spark.createDataFrame(rows, "id string, parent_path string, path string, file_id string, is_dir boolean")
    summaries = spark.createDataFrame([(f, f"about {f}") for f in ("leaf", "a", "z")], "file_id string, l0_abstract string")
    got = {r.parent_path: r.text for r in pipeline.rollup_levels(dentries, summaries).collect()}
    assert set(got) == {"/", *dirs}
    text = "[1]. about leaf"
    assert got[dirs[-1]] == text
    for p in reversed(dirs[1:-1]):
        text = "[1]. " + text[:120]
        assert got[p] == text
    assert got["/d0"] == f"[1]. about a\n[2]. {got['/d0/d1'][:120]}\n[3]. about z"
    assert got["/"] == "[1]. " + got["/d0"][:120]
    assert pipeline.rollup_levels(dentries, summaries.limit(0)).count() == 0


def test_index_reads_only_the_terms_of_a_query(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 40} common term{k}") for k in range(400)] + [(400, None), (401, "中文 common")], "id long, content string")
    assert segments.opened(spark, f"file://{tmp_path}/none") is None
    index = segments.sync(spark, f"file://{tmp_path}/index", docs)
    found = index.scores(["word7"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(bucket" in plan
    assert re.search(r"PushedFilters: \[[^\]]*word7", plan) and "Arrow" not in plan
    want = {r.id: round(r.score, 9) for r in retrieval.bm25(docs, "word7 common 文").collect()}
    assert {r.id: round(r.score, 9) for r in retrieval.bm25(None, "word7 common 文", index=index).collect()} == want and len(want) == 401
    some = spark.range(0, 100)
    here = {r.id: round(r.score, 9) for r in retrieval.bm25(docs.where("id < 100"), "word7 common").collect()}
    assert {r.id: round(r.score, 9) for r in index.scores(["word7", "common"], some).collect()} == here
    assert retrieval.query_terms("中文 Café x1") == ["café", "x1", "中", "文"]


def test_scope_of_an_index_needs_no_join_by_id(spark, sf):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = QUERIES["search_scoped"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_id" in plan and "hashpartitioning(id" not in plan


def test_stored_words_are_one_string(spark, tmp_path):
    contents = ["one two one", "", None, "  ", "x 中文 y1"] * 60
    docs = spark.createDataFrame(list(enumerate(contents)), "id long, content string")
    index = segments.sync(spark, f"file://{tmp_path}/index", docs)
    for now in (index, segments.merged(index)):
        assert dict(spark.read.parquet(f"{now.segments[0]['path']}/documents").dtypes)["w"] == "string"
        assert {tuple(r.w) for r in now.documents.where("id < 5").collect()} == {("one", "two", "one"), (), ("x", "中", "文", "y1")}
        assert now.documents.where("dl <> size(w)").count() == 0
        assert now.frequencies(["one", "two", "", "文"]) == {"one": 60, "two": 60, "文": 60}
        by_place, by_id = (now.scores(["one", "y1"], f.where("id < 150")) for f in (now.places, now.lengths))
        want = {r.id: round(r.score, 9) for r in retrieval.bm25(docs.where("id < 150"), "one y1").collect()}
        assert len(want) == 60
        for got in (by_place, by_id):
            assert {r.id: round(r.score, 9) for r in got.collect()} == want


def test_limits(spark):
    docs = spark.createDataFrame([(k, "common words", [1.0, float(k)]) for k in range(150)], "id long, content string, vector array<float>")
    for mode in retrieval.MODES:
        assert retrieval.search(docs, "common", [1.0, 0.5], mode, limit=0).count() == 10
        assert retrieval.search(docs, "common", [1.0, 0.5], mode, limit=9999).count() == 100
    with pytest.raises(InvalidInput):
        retrieval.search(docs, "common", [1.0, 0.5], limit=-1)


def test_write_forms_that_return(spark):
    dentries = spark.createDataFrame([("/a", True), ("/a/f", False)], "path string, is_dir boolean")
    assert mutations.removed_count(dentries, "/a").first().n == 2
    for wrong in (lambda: mutations.removed_count(dentries, "/no").collect(), lambda: mutations.made_directories(spark.createDataFrame([("/a/f",)], "path string"), dentries).collect()):
        with pytest.raises(Exception, match="not found|a file has"):
            wrong()


def test_sql_search_refuses(spark, sf):
    QUERIES["sql_search_hybrid"](spark, sf).collect()
    for call in ("'x', 'fuzzy'", "'x', 'hybrid', 0"):
        with pytest.raises(Exception, match="search: "):
            spark.sql(f"SELECT * FROM search({call})").collect()


def test_sql_events_refuse(spark, sf):
    QUERIES["tvf_events_since"](spark, sf).collect()
    assert spark.sql("SELECT * FROM events_since(since => NULL, n => NULL)").count() == 999
    assert spark.sql("SELECT * FROM events_since(n => 0)").count() == 0
    for call in ("n => -1", "since => 900000000, n => -1", "since => -5"):
        with pytest.raises(Exception, match="negative"):
            spark.sql(f"SELECT * FROM events_since({call})").collect()
    with pytest.raises(Exception, match="CAST|DATATYPE"):
        spark.sql("SELECT * FROM events_since(since => array(1))").collect()


def test_detail_levels(spark):
    summaries = spark.createDataFrame([("f", None, "F0", "F1"), (None, "d", "D0", "D1")], "file_id string, dentry_id string, l0_abstract string, l1_overview string")
    own = spark.createDataFrame([("f", [1.0, 0.0]), ("d", [1.0, 1.0]), ("gone", [0.0, 1.0])], "id string, vector array<float>")
    get = lambda level: [tuple(r)[:1] + tuple(r)[3:] for r in retrieval.detailed(None, summaries, own, "x", [1.0, 0.1], level, "fulltext").orderBy("id").collect()]
    assert get("abstract") == [("d", "D0"), ("f", "F0"), ("gone", None)]
    assert get("overview") == [("d", "D0", "D1"), ("f", "F0", "F1"), ("gone", None, None)]
    for wrong in (lambda: retrieval.summary_topk(own, None), lambda: retrieval.detailed(None, summaries, own, "x", [1.0, 0.0], "short")):
        with pytest.raises(InvalidInput):
            wrong()


def test_windows_over_a_limit_sort_only_that_many(spark, sf):
    for name in ("tvf_search", "tvf_events_since"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan, name


def test_word_documents(spark):
    ns = 'xmlns:w="http://w" xmlns:mc="http://mc"'
    xml = (
        f"<w:document {ns}><w:body><w:p><w:r><w:t>One &amp; two</w:t><w:tab/><w:t>x</w:t><w:br/><w:instrText>PAGE</w:instrText><w:delText>old</w:delText></w:r></w:p>"
        "<w:p><mc:AlternateContent><mc:Choice><w:t>box</w:t></mc:Choice><mc:Fallback><w:t>box</w:t></mc:Fallback></mc:AlternateContent></w:p></w:body></w:document>"
    )
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    rows = spark.createDataFrame([("/a.docx", held.getvalue()), ("/b.docx", b"PK\x03\x04word/ broken"), ("/c.pdf", b"%PDF-1.4")], "path string, content binary")
    got = {r.path: r.content for r in formats.extracted_text(rows, {"application/pdf": lambda d: "pdf"}).collect()}
    assert got == {"/a.docx": "One & two\tx\n\nbox\n", "/b.docx": None, "/c.pdf": "pdf"}


def test_word_field_codes():
    cases = {
        "a\x13 HYPERLINK \x13 PAGEREF \x14 5\x15 \x14link \x13X\x14y\x15\x15 b\r": "alink y b\n",
        "no\x1efields\x1f\x01here\x07": "no-fieldshere\n",
        "open \x13 never shown": "open ",
        "open \x13 code \x14 result": "open  result",
        "\x13gone\x15kept": "kept",
    }
    for raw, want in cases.items():
        assert word.clean_text(raw) == want


def test_tasks_without_a_result_fail(spark):
    rows = spark.createDataFrame([(1, "a", "w", "{}", "pending", 0, 2), (2, "a", "w", "{}", "pending", 1, 2), (3, "a", "w", "{}", "completed", 0, 2)], "id long, event_type string, workspace_id string, payload string, status string, retry_count int, max_retries int")
    queue = rows.selectExpr("*", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS available_at", "CAST(NULL AS TIMESTAMP_NTZ) AS lease_until")
    got = {r.id: (r.status, r.retry_count, r.last_error) for r in state.work_cycle(queue, "2024-01-02 00:00:00", 10, {"a": lambda t: t.where("false").selectExpr("id", "'' AS error")}).collect()}
    assert got == {1: ("pending", 1, "no result"), 2: ("dead", 2, "no result"), 3: ("completed", 0, None)}


def test_chunks_of_the_fixture_by_plain_loops(spark, sf):
    contents = {r.file_id: r.content for r in fixtures.relation(spark, sf, "contents").collect()}
    got = {}
    for r in QUERIES["storage_chunks"](spark, sf).collect():
        got.setdefault(r.file_id, {})[r.chunk_index] = (r.start_line, r.line_count, r.byte_len, r.chunk_sha256, r.content)
    for f, content in contents.items():
        parts = [x for _, x in sorted(got.get(f, {}).items())]
        assert "".join(x[4] for x in parts) == content
        assert [x[0] for x in parts] == [1 + sum(y[4].count("\n") for y in parts[:k]) for k in range(len(parts))]
        assert all((x[1], x[2], x[3]) == (x[4].count("\n"), len(x[4].encode()), hashlib.sha256(x[4].encode()).hexdigest()) for x in parts)
        assert all(x[4].endswith("\n") for x in parts[:-1])
        assert all(x[2] <= 1024 or x[1] <= 1 for x in parts)
    for r in QUERIES["semantic_chunks"](spark, sf).where("chunk_index = 0").collect():
        section = re.split(r"(?m)^(?=[ \t]*#{1,6}(?:[ \t]|$))", contents[r.file_id].replace("\r\n", "\n"))
        lead = next(s for s in section if s)
        spent, end = 0, 0
        while end < len(lead) and spent + (1 if lead[end] < "\x80" else 4) <= 512:
            spent, end = spent + (1 if lead[end] < "\x80" else 4), end + 1
        assert r.content.rstrip("\n") == lead[:end].rstrip("\n"), r.file_id


def test_embeddings_and_inserted_rows(spark, sf):
    embed = vectors.hashing_embedder()
    for r in QUERIES["embedding_json"](spark, sf).collect():
        assert [round(x, 5) for x in json.loads(r.embedding)] == [round(x, 5) for x in embed(r.r_name)]
    rows = QUERIES["collection_insert"](spark, sf).collect()
    assert len({r.id for r in rows}) == len(rows) == 5
    assert all([round(x, 5) for x in r.vector] == [round(x, 5) for x in embed(r.name)] for r in rows)


def test_path_filters_reach_the_scan(spark, sf, tmp_path):
    fixtures.relation(spark, sf, "dentries").write.parquet(f"{tmp_path}/dentries")
    fixtures.relation(spark, sf, "files_meta").write.parquet(f"{tmp_path}/files_meta")
    view = fs.files_view(spark.read.parquet(f"{tmp_path}/dentries"), spark.read.parquet(f"{tmp_path}/files_meta"))
    plan = view.where("path LIKE '/src1/%'").select("path", "size_bytes")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*StringStartsWith\(path,/src1/\)", plan)
    assert re.search(r"ReadSchema: struct<file_id:string,size_bytes:bigint>", plan)


def _bm25(spark, rows, query, tokeniser="words"):
    docs = spark.createDataFrame(rows, "id long, content string")
    return {r.id: round(r.score, 9) for r in retrieval.bm25(docs, query, tokeniser=tokeniser).collect()}


def _best(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_segments_follow_changes(spark, tmp_path):
    """After each change the index ranks as one that is built anew, and only what changed is indexed."""
    folder = f"file://{tmp_path}/index"
    frame = lambda x: spark.createDataFrame(sorted(x.items()), "id long, content string")
    now = {k: f"common word{k % 9} " * (1 + k % 5) + f"only{k}" for k in range(60)} | {60: None, 61: ""}
    segments.sync(spark, folder, frame(now), "w1")
    assert segments.sync(spark, folder, frame({}), "w1").n == 62  # the watermark says that nothing happened

    def check(index):
        for query in ("common word3", "only7 word1 absent", "fresh common"):
            want = _bm25(spark, sorted(now.items()), query)
            got = {r.id: round(r.score, 9) for r in retrieval.bm25(None, query, index=index).collect()}
            assert got == want
            top = [(r.id, round(r.score, 9)) for r in retrieval.bm25_topk(None, query, 5, index=index).collect()]
            assert top == _best(want, 5)
        assert index.n == len(now)

    for step in ({3: "fresh words", 70: "common fresh"}, {k: None for k in range(10, 14)}, {3: "word3", 70: "gone", 71: "x"}):
        now |= step
        if step.get(10, 0) is None:
            now = {k: v for k, v in now.items() if k not in step}
        index = segments.sync(spark, folder, frame(now))
        check(index)
        assert index.segments[-1]["n"] <= 3 or not step.get(3)
    assert len(index.segments) == 3 and sum(p["n"] for p in index.marks) == 7
    before = index
    index = segments.merged(index)
    check(index)
    check(before)  # a reader keeps its revision
    assert len(index.segments) == 1 and not index.marks
    for k in range(10):  # many small changes are merged by themselves
        now[100 + k] = f"common late{k}"
        index = segments.update(spark, folder, frame({100 + k: now[100 + k]}))
    assert len(index.segments) <= segments.MERGE_SEGMENTS
    check(index)
    index = segments.update(spark, folder, None, spark.createDataFrame([(100,), (999,)], "id long"))
    del now[100]
    check(index)
    assert snapshots.vacuum(spark, folder) > 0
    check(segments.opened(spark, folder))
    with pytest.raises(InvalidInput):
        segments.update(spark, folder, frame(now), tokeniser="bigrams")


def test_two_writers_of_one_revision(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    first = snapshots.commit(spark, folder, 0, [{"path": "a"}], {"x": 1})
    assert snapshots.current(spark, folder) == first and snapshots.at(spark, folder, 1) == first
    snapshots.commit(spark, folder, 1, [], {})
    with pytest.raises(Conflict):
        snapshots.commit(spark, folder, 1, [{"path": "b"}], {})
    assert snapshots.current(spark, folder).revision == 2
    # a commit that broke off is not read, and can be removed
    (tmp_path / "t" / "_manifests" / "000000000003.json").write_text('{"parts": [')
    assert snapshots.current(spark, folder).revision == 2
    with pytest.raises(Conflict):
        snapshots.commit(spark, folder, 2, [], {})
    assert snapshots.repair(spark, folder) == 1
    calls = []

    def change(base):
        if not calls:  # another writer comes in between
            snapshots.commit(spark, folder, base.revision, [{"path": "theirs"}], {})
        calls.append(base.revision)
        return [*base.parts, {"path": "ours"}], {}

    assert [p["path"] for p in snapshots.committed(spark, folder, change).parts] == ["theirs", "ours"] and calls == [2, 3]
    # two sessions that build one index: the second is refused and nothing of it is read
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "id long, content string")
    true_commit = snapshots.commit
    other = f"file://{tmp_path}/index"
    monkeypatch.setattr(segments.snapshots, "commit", lambda *a: (true_commit(spark, other, 0, [], {"tokeniser": "words", "id": "bigint", "keep": []}), true_commit(*a))[1])
    with pytest.raises(Conflict):
        segments.update(spark, other, docs)
    assert segments.opened(spark, other).n == 0


def test_top_k_reads_few_blocks(spark, tmp_path, monkeypatch):
    """A common word with a rare one: blocks without the rare one cannot reach the floor."""
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "SEED_BLOCKS", 3)
    rows = [(k, "the common text " + ("rare " * (1 + k % 3) if 700 <= k < 720 else "filler ") * 2 + f"w{k % 50}") for k in range(1600)]
    docs = spark.createDataFrame(rows, "id long, content string").repartition(4, "id").sortWithinPartitions("id")
    index = segments.sync(spark, f"file://{tmp_path}/index", docs.orderBy("id").coalesce(1))
    for named in (segments.NAMED_BLOCKS, 0):
        monkeypatch.setattr(segments, "NAMED_BLOCKS", named)
        for query, k in (("the rare", 5), ("the", 7), ("the w7 common", 12), ("the", 5000), ("none", 3)):
            want = _best(_bm25(spark, rows, query), k)
            assert [(r.id, round(r.score, 9)) for r in retrieval.bm25_topk(None, query, k, index=index).collect()] == want, query
    found, df = index.candidates(["the", "rare"], 5)
    every = index._of(index.blocks, ["the", "rare"])
    assert found.count() * 10 < every.count() and df == {"the": 1600, "rare": 20}
    bounds = index.bounds(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ReadSchema: struct<[^>]*(ids|tfs|dls)", bounds)


def test_postings_name_places_and_not_ids(spark, tmp_path):
    """Long ids stand once a document; a block over several Arrow batches is packed whole."""
    rows = [(k, f"common word{k % 7} " * (1 + k % 3) + f"only{k}") for k in range(600)] + [(600, None)]
    docs = spark.createDataFrame(rows, "id long, content string").select(F.lpad(F.col("id").cast("string"), 64, "0").alias("id"), "content").coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        index = segments.sync(spark, f"file://{tmp_path}/index", docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [c for c, t in index.blocks.dtypes if "string" in t] == ["term"]
    # a term has one row in each block that holds it
    assert index.blocks.groupBy("term", "block").count().where("count > 1").count() == 0
    for query in ("common word3", "only7 word1"):
        want = {f"{k:064d}": v for k, v in _bm25(spark, rows, query).items()}
        assert {r.id: round(r.score, 9) for r in retrieval.bm25(None, query, index=index).collect()} == want
        assert [(r.id, round(r.score, 9)) for r in retrieval.bm25_topk(None, query, 5, index=index).collect()] == _best(want, 5)


def test_tokenisers(spark):
    from tessera.functions import text

    cases = ["中文搜索 Café x1", "我", "a我b", "我们ab中", "", "x-y 𠮷野家"]
    want = [["中文", "文搜", "搜索", "café", "x1"], ["我"], ["a", "我", "b"], ["我们", "ab", "中"], [], ["x", "y", "𠮷野", "野家"]]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", text.tokens(F.col("t"), "bigrams").alias("w")).orderBy("k").collect()
    assert [r.w for r in rows] == want == [text.tokens_of(c, "bigrams") for c in cases]
    docs = [(1, "中文搜索引擎"), (2, "中国文学"), (3, "搜索")]
    assert set(_bm25(spark, docs, "文搜")) == {1, 2, 3} and set(_bm25(spark, docs, "文搜", "bigrams")) == {1}


def test_building_an_index_shuffles_no_postings(spark, tmp_path, monkeypatch):
    docs = spark.range(3000).selectExpr("id", "concat('w', id % 700, ' both ', id) AS content")
    monkeypatch.setattr(type(docs), "repartition", lambda *a, **k: pytest.fail("postings are dealt"))
    assert segments.update(spark, f"file://{tmp_path}/i", docs).frequencies(["both"]) == {"both": 3000}


def test_a_semantic_search_builds_no_text_index(spark, sf, monkeypatch):
    from tessera.plans import registry
    from tessera.plans.catalog import QUERIES

    monkeypatch.setattr(registry.Source, "text_index", lambda *a, **k: pytest.fail("an index of texts"))
    assert QUERIES["search_semantic"](spark, sf).count() == 10


def test_a_stored_row_is_a_term_in_a_stretch_of_blocks(spark, tmp_path, monkeypatch):
    """One row a term and block was sorted by each task and spilled three times the input."""
    docs = spark.range(0, 3000, 1, 2).selectExpr("id", "concat('w', id % 700, ' both both ', id, ' Ünï') AS content")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for words, most in ((segments.STRETCH, 2), (2000, 10)):
            monkeypatch.setattr(segments, "STRETCH", words)
            index = segments.update(spark, f"file://{tmp_path}/{words}", docs)
            stored = spark.read.parquet(f"{index.segments[0]['path']}/postings").where("term = 'both'").count()
            assert 2 <= stored <= most and index.blocks.where("term = 'both'").count() == 12
            of = F.explode(F.arrays_zip("ats", "tfs", "dls")).alias("p")
            got = index.blocks.select("term", "seq", "block", of).select("term", "seq", "block", F.col("p.ats").alias("at"), "p.tfs", "p.dls").join(index.names, ["seq", "block", "at"])
            want = docs.selectExpr("id", "explode(split(lower(content), ' ')) AS term").groupBy("term", "id").count()
            rows = lambda df: sorted(map(tuple, df.collect()))
            assert rows(got.select("term", "id", "tfs")) == rows(want) and {r.dls for r in got.select("dls").distinct().collect()} == {5}
            assert index.blocks.where("n <> size(ats) OR max_tf <> array_max(tfs) OR min_dl <> array_min(dls)").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_of_documents_are_counted_where_the_texts_are(spark, sf):
    """Texts are shuffled once, by id; a row a document and word was."""
    plan = QUERIES["fn_explode"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")


def test_the_dictionary_composes_a_text_once(spark):
    texts = spark.createDataFrame([("a",), (" ",), (None,)], "text string")
    keyed = vectors.embed_dictionary(texts, spark.createDataFrame([], "cache_key string"), "m")
    assert keyed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and [r.text for r in keyed.collect()] == ["a"]
