"""Registration of queries beside their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Register:
    """Collects queries; the decorated function takes a loader of tables and returns a DataFrame."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(fn):
            key = name or fn.__name__
            self.queries[key] = lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t))
            if sql:
                self.oracles[key] = sql
            return fn

        return add
