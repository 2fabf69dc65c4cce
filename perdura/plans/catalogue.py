"""All registered queries of the library."""

from __future__ import annotations

from perdura.plans import metric_queries, series_queries, source_queries
from perdura.streaming import rolling


def queries() -> dict[str, series_queries.Query]:
    return series_queries.QUERIES | metric_queries.QUERIES | source_queries.QUERIES | rolling.QUERIES


def oracle_sql() -> dict[str, str]:
    return series_queries.SQL | metric_queries.SQL | source_queries.SQL | rolling.SQL
