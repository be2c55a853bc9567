"""All registered queries of the vessel-track engine, by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("view_queries", "function_queries", "ingest_queries", "track_queries", "listing_queries", "trail_queries", "coast_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidewake.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidewake.plans.{name}").ORACLE_SQL
    return out
