"""All registered queries of the library and the SQL that they are held against."""

from __future__ import annotations

from tessera.plans import answer_queries, case_queries, search_queries, text_queries

ALL = search_queries.QUERIES | text_queries.QUERIES | case_queries.QUERIES | answer_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
