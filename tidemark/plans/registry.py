"""All queries of the library by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import bar_queries, grading_queries, maintain_queries, track_queries

MODULES = (bar_queries, grading_queries, maintain_queries, track_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
