"""Queries over the driver's tables, and the same plans for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kernels
from .catalog import PLANS
from .forms import FORMS
from .views import to_duckdb, to_spark


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(to_spark(sql, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(sql) for name, sql in PLANS.items()} | FORMS | {f.__name__: f for f in kernels.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: to_duckdb(sql) for name, sql in PLANS.items()} | kernels.oracles()
