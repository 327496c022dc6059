"""The registry of named queries and the SQL each one is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(world) -> DataFrame` under `name`, with the SQL that gives the same rows."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from loadwarden.catalog.given import Given
            return fn(Given(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap
