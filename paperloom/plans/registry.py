"""The queries of the library and their SQL."""

from __future__ import annotations

from . import contract_queries, dedup_queries, eval_queries, field_queries, project_queries, rank_queries, rule_queries  # noqa: F401
from .views import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
