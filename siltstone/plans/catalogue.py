"""Registry of the engine's own queries: each plan module gives QUERIES and ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import match_plans, posting_plans, relational_plans, retrieval_plans, screen_plans, source_plans, text_plans

_MODULES = (text_plans, relational_plans, retrieval_plans, posting_plans, screen_plans, match_plans, source_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        found.update(m.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found.update(m.ORACLES)
    return found
