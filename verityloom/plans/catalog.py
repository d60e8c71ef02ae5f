"""All core queries by name with their SQL; subject modules each bring QUERIES and ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verityloom.plans import authority, documents, evaluation, evidence, graphs, hybrid, lookups, retrieval, training

MODULES = (training, retrieval, authority, graphs, hybrid, documents, evidence, evaluation, lookups)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["authority_aware_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
