"""All registered queries of the places engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.plans import dashboard, idioms, matching, mechanisms, pipelines, relational, scalars, services, states

MODULES: tuple = (relational, scalars, matching, states, services, idioms, dashboard, mechanisms, pipelines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.query.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.query.oracles
    return found
