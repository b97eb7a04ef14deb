"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Whole tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


def collection() -> tuple[Callable, dict, dict]:
    """A decorator that registers `f(t)`, t giving tables by name, and the dictionaries it fills."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                oracles[name] = sql
            return f

        return add

    return query, queries, oracles
