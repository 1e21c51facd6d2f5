"""Queries over the generated tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analytics, events, graphs, identity, lexical, lifecycle, memory, ranking, records, symbols, tables, text, vectors  # noqa: F401
from tessera.plans.registry import QUERIES, SQL, Tables

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
