"""All registered queries of the event-skill operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def also(name: str, earlier: str) -> None:
    """Keep an earlier name of a query that is still asked for."""
    QUERIES[earlier] = QUERIES[name]
    if name in SQL:
        SQL[earlier] = SQL[name]
