"""All queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from limitlens.llm import queries_dedup, queries_filter, queries_models, queries_pages

_MODULES = (queries_dedup, queries_filter, queries_models, queries_pages)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
