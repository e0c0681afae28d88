"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arrayloom.plans import curated, interactions, labels, models, sequences, training

_MODULES = [curated, sequences, training, labels, interactions, models]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["detected_matrix"](spark, folder)
