"""Collects the queries and oracles of the query modules in `plans`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_bridges, queries_names, queries_relational, queries_resolution, queries_sources

MODULES = (queries_names, queries_relational, queries_resolution, queries_sources, queries_bridges)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
