"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named tables (space-separated) as a query."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables.split()))
        if sql is not None:
            SQL[name] = sql
        return f

    return add
