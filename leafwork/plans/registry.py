"""Collects the queries and their oracle SQL from the query modules."""

from __future__ import annotations

from leafwork.plans import page_queries, text_queries
from leafwork.plans.frame import literal, over_tables


def _specs() -> dict:
    return text_queries.SPECS | page_queries.SPECS


def queries() -> dict:
    return {name: over_tables(spec) for name, spec in _specs().items()} | page_queries.EXTRA


def oracle_sql() -> dict[str, str]:
    return {name: literal(spec) for name, spec in _specs().items()}
