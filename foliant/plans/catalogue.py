"""The registry of queries and their DuckDB equivalents."""

from __future__ import annotations

from foliant.plans import file_queries, layout_queries, run_queries, table_queries, text_queries

QUERIES: dict = text_queries.QUERIES | table_queries.QUERIES | run_queries.QUERIES | layout_queries.QUERIES | file_queries.QUERIES
ORACLE: dict[str, str] = text_queries.ORACLE | table_queries.ORACLE | run_queries.ORACLE | layout_queries.ORACLE | file_queries.ORACLE
