import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import InvalidInput, InvalidPath
from tessera.functions import paths, records, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("/foo//bar/", "/foo/bar"), ("/foo/./bar", "/foo/bar"), ("///", "/"), ("", "/"), ("/a/../b", "/b"), ("/..", None), ("a", None), ("/a:b", None), ("/" + "x" * 256, None)])
def test_normalize(spark, raw, want):
    assert one(spark, raw, paths.normalize) == want
    if want is None:
        with pytest.raises(InvalidPath):
            paths.require_path(raw)
    else:
        assert paths.require_path(raw) == want


def test_lenient_and_null(spark):
    assert one(spark, "docs/", paths.normalize_lenient) == "/docs"
    assert one(spark, None, paths.normalize) is None


@pytest.mark.parametrize(("pattern", "path", "want"), [("/a/*.txt", "/a/b.txt", True), ("/a/*.txt", "/a/b/c.txt", False), ("/a/**/*.txt", "/a/b/c/d.txt", True), ("/a/**/*.txt", "/a/d.txt", True), ("/a?c", "/abc", True), ("/a?c", "/a/c", False), ("/a+b", "/aab", False), ("/**", "/x/y", True)])
def test_glob(spark, pattern, path, want):
    assert one(spark, path, lambda c: paths.glob(c, pattern)) is want


def test_glob_prefix(spark):
    for pattern, want in {"/a/b*/c": "/a", "/a/b": "/a/b", "*": "/", "/x?": "/"}.items():
        assert paths.glob_prefix(pattern) == want
        assert one(spark, pattern, paths.glob_prefix_of) == want


def test_boundary(spark):
    assert one(spark, "/docs_alt", lambda c: paths.under(c, "/docs")) is False
    assert one(spark, "/docs/a", lambda c: paths.under(c, "/docs")) is True


def test_same_path_folds_case_and_accents(spark):
    assert one(spark, "/Café", lambda c: paths.same_path(c, F.lit("/cafe"))) is True


def test_ancestors(spark):
    assert one(spark, "/a/b/c.txt", paths.ancestors) == ["/", "/a", "/a/b"]
    assert one(spark, "/a", paths.ancestors) == ["/"]
    assert one(spark, "/", paths.ancestors) == []


@pytest.mark.parametrize(("raw", "want"), [("a\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""])])
def test_lines(spark, raw, want):
    assert one(spark, raw, text.lines) == want
    assert one(spark, raw, text.line_count) == len(want)


@pytest.mark.parametrize(("raw", "want"), [("abcd", 1), ("abcde", 2), ("知识abcd", 3), ("", 0)])
def test_token_estimate(spark, raw, want):
    assert one(spark, raw, text.token_estimate) == want


def test_citations(spark):
    assert one(spark, "[1] and [12]", text.citation_indices) == [1, 12]
    assert one(spark, "[abc] [] [3", text.citation_indices) == []


@pytest.mark.parametrize(("raw", "want"), [("---\na: b\n---\nbody", "body"), ("---\nopen", "---\nopen"), ("x\n---\n", "x\n---\n"), ("---\n---\n", "")])
def test_front_matter(spark, raw, want):
    assert one(spark, raw, text.without_front_matter) == want


def test_language(spark):
    assert one(spark, "知识库的说明", text.output_language) == "zh-CN"
    assert one(spark, "カタカナ漢字", text.output_language) == "en"
    assert one(spark, "", text.output_language) == "en"


def test_mask(spark):
    assert one(spark, "short", text.mask_token) == "****"
    assert one(spark, "vk_0123456789abcdef", text.mask_token) == "vk_0123…cdef"


def test_mime(spark):
    assert one(spark, bytearray(b"%PDF-1.7"), text.mime_type, "binary") == "application/pdf"
    assert one(spark, bytearray(b"\xff\xfe\x00"), text.mime_type, "binary") == "application/octet-stream"
    assert one(spark, bytearray("é".encode()), text.mime_type, "binary") == "text/plain"


def test_filter_language(spark):
    df = spark.createDataFrame([(1, '{"p": 5, "b": "x", "f": true}'), (2, '{"p": "5"}'), (3, "not json"), (4, None)], "id int, meta string")
    ids = lambda *must: {r.id for r in df.where(records.compile_filter({"must": list(must)}, F.col("meta"))).collect()}
    clause = lambda op, v, f="meta.p": {"field": f, "op": op, "value": v}
    assert ids(clause("eq", 5)) == {1}
    assert ids(clause("eq", "5")) == {2}
    assert ids(clause("lt", 100), clause("eq", "x", "meta.b")) == {1}
    assert ids(clause("in", [5, "5"])) == {1, 2}
    assert ids(clause("eq", True, "meta.f")) == {1}
    assert records.compile_filter({"must": []}, F.col("meta")) is None


@pytest.mark.parametrize("spec", [{"should": []}, {"must": [{"field": "price", "op": "eq", "value": 1}]}, {"must": [{"field": "meta.a.b", "op": "eq", "value": 1}]}, {"must": [{"field": "meta.a", "op": "gt", "value": True}]}, {"must": [{"field": "meta.a", "op": "in", "value": []}]}, {"must": [{"field": "meta.a", "op": "eq", "value": [1]}]}, {"must": [{"field": "meta.a", "op": "like", "value": "x"}]}])
def test_filter_rejects(spark, spec):
    with pytest.raises(InvalidInput):
        records.compile_filter(spec, F.col("meta"))


def test_projection_rejects_internal_names():
    with pytest.raises(InvalidInput):
        records.checked_projection(["vector"])
    assert records.checked_projection([]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "..", "", "bc"]), max_size=6))
def test_normal_paths_stay(parts):
    raw = "/" + "/".join(parts)
    try:
        once = paths.require_path(raw)
    except InvalidPath:
        return
    assert paths.require_path(once) == once
