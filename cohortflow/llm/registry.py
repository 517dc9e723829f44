"""Registration of the queries of this subpackage, and what they share."""

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

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def fold(parts: int, held: int) -> Column:
    """True for the documents that are held out of learning; a null id is not held out."""
    of = F.crc32(F.col("doc_id").cast("string")) % parts
    return F.coalesce(of == held, F.lit(False))
