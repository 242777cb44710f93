"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans import fitted_queries, model_queries, rule_queries, sales_queries, source_queries  # noqa: F401
from larder.plans.registry import ORACLE, QUERIES, runner


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def run(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return runner(QUERIES[name])(spark, folder)
