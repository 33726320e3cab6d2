"""All queries of the panel engine by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronopanel.plans import build_queries, check_queries, cost_queries, feature_queries, model_queries, portfolio_queries, regime_queries, session_queries, stream_queries

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {**feature_queries.QUERIES, **session_queries.QUERIES, **regime_queries.QUERIES, **portfolio_queries.QUERIES, **stream_queries.QUERIES, **check_queries.QUERIES, **build_queries.QUERIES, **model_queries.QUERIES, **cost_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
