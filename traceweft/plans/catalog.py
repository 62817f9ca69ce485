"""All registered queries of the analytics engine with their DuckDB counterparts."""

from __future__ import annotations

from traceweft.plans import q_aggregates, q_columns, q_files, q_keys, q_models, q_profile, q_rules, q_sampling, q_sources, q_stats  # noqa: F401
from traceweft.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
