"""Ranks, first and last rows (WIN1 to WIN5)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seq_ranks(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column | None = None
) -> DataFrame:
    """Dense rank from the first and from the last value of ``order``.

    Rows with a NULL order or a NULL key stay and have NULL ranks.  Without a
    chunk the frame must hold a bounded number of rows per key, as the weekly
    frames do (one row per calendar week).  Raw measurements pass a chunk, which
    grows with the order: rows are ranked inside it, and its offset and size,
    one row per key and chunk, make the rank of the key.
    """
    ranked_by = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, order]])
    by = list(keys) if chunk is None else [*keys, "_chunk"]
    up = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()))
    down = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last()))
    if chunk is None:
        return df.withColumns(
            {"seq_asc": F.when(ranked_by, up), "seq_desc": F.when(ranked_by, down)}
        )
    inside = df.withColumn("_chunk", chunk).withColumns({"_up": up, "_down": down})
    along = Window.partitionBy(*keys).orderBy("_chunk")
    sizes = inside.where(ranked_by).groupBy(*by).agg(F.max("_up").cast("bigint").alias("_size"))
    sizes = sizes.withColumns(
        {
            "_upto": F.sum("_size").over(along),
            "_all": F.sum("_size").over(Window.partitionBy(*keys)),
        }
    )
    asc = F.col("_upto") - F.col("_size") + F.col("_up")
    desc = F.col("_all") - F.col("_upto") + F.col("_down")
    return (
        inside.join(sizes, by, "left")
        .withColumns({"seq_asc": F.when(ranked_by, asc), "seq_desc": F.when(ranked_by, desc)})
        .select(*df.columns, "seq_asc", "seq_desc")
    )


def keep_one(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first"
) -> DataFrame:
    """First or last row per key.

    The rank filter is applied inside each map task before the shuffle, so a hot
    key sends one row per task.  End ``order`` with a unique column.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"unknown keep {keep}")
    by = [F.asc(c) if keep == "first" else F.desc(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_last_pair(
    df: DataFrame,
    key: str,
    order: str,
    labels: tuple[str, str] = ("first", "last"),
    lone: bool = False,
    spread: bool = False,
) -> DataFrame:
    """Rows at the first and the last value of ``order``, labelled.

    A patient with a single occasion is dropped, or kept as first with ``lone``.
    Weekly frames use a window over the patient; raw measurements pass ``spread``,
    so that both ends come from an aggregate and a hot patient stays spread out.
    """
    known = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    if spread:
        ends = known.groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
        marked = known.join(ends, key)
    else:
        w = Window.partitionBy(key)
        marked = known.withColumns({"_lo": F.min(order).over(w), "_hi": F.max(order).over(w)})
    at = F.when(F.col(order) == F.col("_lo"), labels[0]).otherwise(labels[1])
    picked = marked.where((F.col(order) == F.col("_lo")) | (F.col(order) == F.col("_hi")))
    if not lone:
        picked = picked.where(F.col("_lo") < F.col("_hi"))
    return picked.withColumn("seq", at).drop("_lo", "_hi")


def argmin_row(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The row at the lowest value, the earliest on ties."""
    return keep_one(df.where(F.col(value).isNotNull()), [key], [value, order])


def first_after_anchor(
    df: DataFrame, key: str, order: str, anchor: str, qualifies: Column
) -> DataFrame:
    """First qualifying position after the anchor of each key, else the last one.

    ``found`` tells which; both are NULL for a key without later rows.
    """
    later = F.col(order) > F.col(anchor)
    hit = F.min(F.when(later & qualifies, F.col(order)))
    end = F.max(F.when(later, F.col(order)))
    return (
        df.groupBy(key, anchor)
        .agg(hit.alias("_hit"), end.alias("_end"))
        .select(
            key,
            anchor,
            F.coalesce("_hit", "_end").alias("position"),
            F.when(F.col("_end").isNotNull(), F.col("_hit").isNotNull()).alias("found"),
        )
    )
