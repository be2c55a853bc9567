"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries: each has QUERIES and may have ORACLE_SQL.
MODULES = ("q_audit", "q_duplicates", "q_files", "q_models", "q_tokens", "q_vectors")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"tidewake.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tidewake.llm.{name}"), "ORACLE_SQL", {})
    return out
