"""All core queries by name, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that define QUERIES and ORACLE_SQL.
MODULES = ["packed", "scalars", "documents", "relational", "streams", "entities", "wording", "evidence", "scoring"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query, over all modules."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"paperloom.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, over all modules."""
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"paperloom.plans.{m}").ORACLE_SQL
    return out
