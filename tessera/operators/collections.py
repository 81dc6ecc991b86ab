"""Schema-first collections: rows of JSON read under a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.operators import retrieval

INTEGERS, FLOATS, BOOLEANS = {"int", "integer", "int32", "int64", "long", "bigint"}, {"float", "double", "float32", "float64", "number"}, {"bool", "boolean"}


def sql_type(declared: str) -> str:
    kind = declared.lower()
    return "long" if kind in INTEGERS else "double" if kind in FLOATS else "boolean" if kind in BOOLEANS else "string"


def decoded(row: Column, name: str, declared: str) -> Column:
    """A field of a JSON row. Numbers and booleans of another JSON type are null; a string field takes
    anything as text, a JSON null as ``null``; a missing key is null."""
    if not name.replace("_", "a").isalnum():
        raise InvalidInput(f"field: {name!r}")
    value = F.try_variant_get(F.try_parse_json(row), f"$.{name}", "variant")
    kind, target = F.schema_of_variant(value), sql_type(declared)
    if target == "long":
        return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "long"))
    if target == "double":
        return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    if target == "boolean":
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    return F.when(kind == "VOID", "null").when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def collection_table(rows: DataFrame, fields: Sequence[tuple[str, str]], json_col: str = "row") -> DataFrame:
    """id and the declared fields of JSON rows; all rows, without a silent cap."""
    return rows.select(decoded(F.col(json_col), "id", "string").alias("id"), *[decoded(F.col(json_col), n, t).alias(n) for n, t in fields])


def collection_search(collection: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Nearest rows, without their vectors."""
    return retrieval.vector_topk(collection, query, k).drop("vector", "workspace_id", "score_type")
