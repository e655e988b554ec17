"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, start: str = ""):
    """Register a function under its name, with its SQL; SQL that begins with a comma or a select goes on from `start`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = start + sql
        return f

    return add
