"""Ordered work that stays spread out when one key holds most of the rows.

A plain window puts all rows of a key into one task.  Here the ordered values of
a key are first cut into chunks (hours of a time line, narrow value bands), the
window runs inside a chunk, and only one row per chunk crosses to the key level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalars import col, floor_div, micros

# Width of a value band: bands grow by 0.5 % of the value.
BANDS_PER_E = 200
BAND_OFFSET = 1_000_000


def time_chunk(ts: Column | str, seconds: int = 3600) -> Column:
    return floor_div(micros(ts), seconds * 1_000_000)


def value_band(value: Column | str) -> Column:
    """Order-keeping band of a number; at most some 600,000 bands exist."""
    v = col(value).cast("double")

    def size(x: Column) -> Column:
        return F.floor(F.ln(x) * BANDS_PER_E) + BAND_OFFSET

    return (
        F.when(v > 0, size(v)).when(v < 0, -F.ceil(size(-v))).otherwise(F.lit(0)).cast("bigint")
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, str],
    chunk: Column | None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums (``totals``: new name -> column) along ``order``.

    ``order`` is unique within the keys and ``chunk`` grows with it.  Without a
    chunk one window per key runs; only for a frame of a checked size.
    """

    def ordered(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(ordered(order))
        upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: F.sum(c).over(upto) for n, c in totals.items()})
    df, by = df.withColumn("_chunk", chunk), list(keys)

    inside = (
        Window.partitionBy(*by, "_chunk")
        .orderBy(ordered(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*by)
        .orderBy(ordered("_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    names = list(totals)
    offsets = (
        df.groupBy(*by, "_chunk")
        .agg(*[F.sum(totals[n]).alias(f"_sum_{n}") for n in names])
        .select(
            *by,
            "_chunk",
            *[
                F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}")
                for n in names
            ],
        )
    )
    inner = df.withColumns({n: F.sum(totals[n]).over(inside) for n in names})
    return (
        inner.join(offsets, [*by, "_chunk"])
        .withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in names})
        .drop("_chunk", *[f"_off_{n}" for n in names])
    )


def dense_positions(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column
) -> DataFrame:
    """One row per distinct (keys, order): dense rank from both ends."""
    distinct = df.where(F.col(order).isNotNull()).select(*keys, order).distinct()
    ranked = running_totals(
        distinct.withColumn("_one", F.lit(1).cast("bigint")),
        keys,
        order,
        {"seq_asc": "_one"},
        chunk,
    )
    size = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        ranked.join(size, list(keys))
        .withColumn("seq_desc", F.col("_n") + 1 - F.col("seq_asc"))
        .drop("_one", "_n")
    )
