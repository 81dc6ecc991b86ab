"""All registered queries, and the SQL that states their results."""

from tessera.plans import fs_queries, relational, retrieval_queries, sql_queries, state_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
