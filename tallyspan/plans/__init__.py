"""Registered queries: each operator applied to the driver's tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Register a function of (read), where ``read(table)`` gives a table of the input folder."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        key = name or f.__name__
        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return put


def load() -> None:
    from . import graphs, joins, lines, ratchets, readers, records, reports, similar  # noqa: F401
