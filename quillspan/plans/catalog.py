"""All registered queries: name -> function, and name -> SQL that gives the same rows."""

from __future__ import annotations

from . import file_queries, layout_queries, page_queries, part_queries, review_queries, table_queries, text_queries

MODULES = (text_queries, page_queries, table_queries, review_queries, file_queries, layout_queries, part_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
