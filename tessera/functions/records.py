"""Validation of vector records, composite keys, and the metadata filter language."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidInput

META_BYTES, TAGS, TAG_BYTES, CATEGORY_BYTES, TEXT_BYTES, NAME_BYTES, PK_BYTES = 16 * 1024, 8, 128, 64, 65_535, 64, 256
PROJECTABLE = ("dataset", "category", "tags", "text", "meta", "created_at", "updated_at")
NAME = r"^[A-Za-z0-9_-]+$"
IN_VALUES = 100


def is_name(name: Column) -> Column:
    return F.regexp_like(name, F.lit(NAME)) & (F.octet_length(name) <= NAME_BYTES)


def build_pk(dataset: Column, id_: Column) -> Column:
    """``dataset:id``; null where a part or the whole is not valid."""
    pk = F.concat_ws(":", dataset, id_)
    return F.when(is_name(dataset) & F.regexp_like(id_, F.lit(NAME)) & (F.octet_length(pk) <= PK_BYTES), pk)


def record_error(text: Column, category: Column, tags: Column, meta: Column) -> Column:
    """The first broken rule of a record, null where it is valid."""
    return (
        F.when(text.isNull() | (text == ""), "text is empty")
        .when(F.octet_length(text) > TEXT_BYTES, "text is too long")
        .when(category == "", "category is empty")
        .when(F.octet_length(category) > CATEGORY_BYTES, "category is too long")
        .when(F.size(tags) > TAGS, "too many tags")
        .when(F.exists(tags, lambda t: (t == "") | (F.octet_length(t) > TAG_BYTES)), "a tag is empty or too long")
        .when(F.octet_length(meta) > META_BYTES, "meta is too long")
    )


def checked_projection(fields: Sequence[str] | None) -> list[str]:
    """The columns to return beside id and score; raises on names that are not for callers."""
    fields = list(PROJECTABLE if fields is None else fields)
    for name in fields:
        if name not in PROJECTABLE:
            raise InvalidInput(f"output_fields: {name!r} is not projectable")
    return fields


def _typed(meta: Column, key: str, value: Any) -> tuple[Column, Column]:
    """(the key's value if it has the literal's type, the literal)."""
    found = F.try_parse_json(meta)
    kind = F.schema_of_variant(F.try_variant_get(found, f"$.{_quoted(key)}", "variant"))
    if isinstance(value, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(found, f"$.{_quoted(key)}", "boolean")), F.lit(value)
    if isinstance(value, (int, float)):
        number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(found, f"$.{_quoted(key)}", "double"))
        return number, F.lit(float(value))
    return F.when(kind == "STRING", F.try_variant_get(found, f"$.{_quoted(key)}", "string")), F.lit(value)


def _quoted(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else f"['{key}']".removeprefix(".")


def compile_filter(spec: dict | None, meta: Column) -> Column | None:
    """A filter ``{"must": [{"field": "meta.<key>", "op": ..., "value": ...}]}`` as a condition.

    Clauses are all required. ``eq`` takes a scalar, ``gt gte lt lte`` a number or string, ``in``
    1 to 100 scalars. Values are compared within their JSON type. No clause is no filter.
    """
    if spec is None:
        return None
    if not isinstance(spec, dict) or set(spec) - {"must"} or not isinstance(spec.get("must", []), list):
        raise InvalidInput("filter: only a list under 'must' is known")
    out: Column | None = None
    for clause in spec.get("must", []):
        if not isinstance(clause, dict) or set(clause) != {"field", "op", "value"}:
            raise InvalidInput("filter: a clause has field, op and value")
        m = re.fullmatch(r"meta\.([A-Za-z0-9_-]+)", str(clause["field"]))
        if not m:
            raise InvalidInput(f"filter: field {clause['field']!r}")
        op, value, key = clause["op"], clause["value"], m[1]
        scalar = isinstance(value, (str, int, float, bool))
        if op == "eq" and scalar:
            found, literal = _typed(meta, key, value)
            term = found == literal
        elif op in ("gt", "gte", "lt", "lte") and isinstance(value, (str, int, float)) and not isinstance(value, bool):
            found, literal = _typed(meta, key, value)
            term = {"gt": found > literal, "gte": found >= literal, "lt": found < literal, "lte": found <= literal}[op]
        elif op == "in" and isinstance(value, list) and 1 <= len(value) <= IN_VALUES and all(isinstance(v, (str, int, float, bool)) for v in value):
            term = None
            for v in value:
                found, literal = _typed(meta, key, v)
                term = (found == literal) if term is None else term | (found == literal)
        else:
            raise InvalidInput(f"filter: {op!r} with this value")
        term = F.coalesce(term, F.lit(False))
        out = term if out is None else out & term
    return out


def tag_filter(category: Column, tags: Column, want_category: str | None, want_tags: Sequence[str]) -> Column:
    """Category equal and every tag present."""
    out = F.lit(True) if want_category is None else category == want_category
    for t in want_tags:
        out = out & F.array_contains(tags, t)
    return out
