"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(configure(spark), base)

        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ts_text(name: str) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def ts_sql(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def day_text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def day_sql(name: str) -> str:
    return f"CAST({name} AS VARCHAR) AS {name}"


def r(*names: str, digits: int = 6) -> str:
    """Rounded columns of a select list."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
