"""Queries over fields that pack several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators.packed_values import split_values
from paperloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per party of a contract."""
    return split_values(table(spark, sf_dir, "sample_contract"), "contract_id", "parties", out="party")


QUERIES = {"p4_found": p4_found}
ORACLE_SQL: dict[str, str] = {}
