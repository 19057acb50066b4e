"""All registered queries and their SQL."""

from __future__ import annotations

from limitlens.registry import exact_queries, limit_queries, many_queries, order_queries, profile_queries, published_queries, report_queries, source_queries, table_queries, text_queries

_MODULES = (limit_queries, report_queries, profile_queries, text_queries, table_queries, source_queries, many_queries, exact_queries, order_queries, published_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
