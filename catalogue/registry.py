"""Query registry: a name, a Spark function and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardstone.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; ``tables(name)`` scans a given table."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


class Tables:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}.parquet")
