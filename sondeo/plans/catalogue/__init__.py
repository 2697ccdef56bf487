"""Named queries over the test tables, each beside the SQL it must agree with.

Every query runs over whole tables. Where a table has no column of the kind an operator
needs (formatted text, currencies, merged cells), the query derives it from the table's own
rows, and the SQL derives it the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with the equivalent SQL where it can be written."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return register


def add(name: str, fn: Query, sql: str | None = None) -> None:
    query(sql, name)(fn)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Import every module that registers queries."""
    from sondeo.plans.catalogue import analyses, cells, grids, groups, reports, statements, workbooks  # noqa: F401
