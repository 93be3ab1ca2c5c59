"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duckdb, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register a function of the named tables (views or sample tables) as a query, with SQL for the same rows."""

    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[view(spark, sf_dir, t) for t in tables.split()])

        QUERIES[name] = run
        if sql:
            SQL[name] = duckdb(sql)
        return build

    return register
