"""Registry of the library's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import case_queries, consistency_queries, gate_queries, ownership_queries, page_type_queries, relational_queries, scalar_queries, sequence_queries, state_queries, text_queries, trusted_queries, workflow_queries

FLAGSHIP = "rule_findings"

_MODULES = (relational_queries, sequence_queries, text_queries, case_queries, ownership_queries, gate_queries, page_type_queries, consistency_queries, workflow_queries, scalar_queries, trusted_queries, state_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
