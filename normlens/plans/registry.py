"""All queries of the library proper and their DuckDB counterparts."""

from __future__ import annotations

from normlens.plans import file_queries, geometry_queries, metric_queries, pixel_queries, scoring_queries


def _all() -> dict:
    return scoring_queries.QUERIES | metric_queries.QUERIES | file_queries.QUERIES | geometry_queries.QUERIES | pixel_queries.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
