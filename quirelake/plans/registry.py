"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from quirelake.plans import memory_queries, pipeline_queries, reference_checks, status, text_queries

_MODULES = [reference_checks, status, memory_queries, text_queries, pipeline_queries]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
