"""Joins (JOIN1 to JOIN11).

No side is ever broadcast by hint: Spark broadcasts a side when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles,
and adaptive execution splits the partition of a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalars import DAY_MICROS, elapsed_days, floor_div, micros


def attach(df: DataFrame, attributes: DataFrame, on: str | list[str]) -> DataFrame:
    """Bring attributes of a deduplicated side; unmatched rows stay."""
    return df.join(attributes, on, "left")


def match(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "inner")


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keep rows whose composite key qualifies; bring the other key columns."""
    how = "inner" if set(keys.columns) - set(on) else "left_semi"
    return df.join(keys, on, how)


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Drop listed keys.  A NULL in the list removes nothing."""
    return df.join(keys, on, "left_anti")


def net_orders(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Paid orders whose fee exceeds the sum of their refunds, or with none."""
    paid_back = refunds.groupBy("oid").agg(F.sum("total").alias("refund_amount"))
    kept = F.col("refund_amount").isNull() | (F.col("fee") > F.col("refund_amount"))
    return orders.join(paid_back, "oid", "left").where(kept)


def flag_member(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """True where the key is listed, false otherwise (also for a NULL key)."""
    listed = keys.select(on).distinct().withColumn(name, F.lit(True))
    return df.join(listed, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def patient_star(
    fact: DataFrame,
    dims: Sequence[tuple[DataFrame, str | list[str] | Column]],
    where: Column | None = None,
) -> DataFrame:
    """Left joins from a fact table along its dimensions, filtered at the end.

    A filter on a dimension turns its outer join into an inner one and moves to
    the dimension's scan; the optimizer does both.
    """
    out = fact
    for dim, on in dims:
        out = out.join(dim, on, "left")
    return out if where is None else out.where(where)


def with_offset(
    events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor: str, name: str = "days"
) -> DataFrame:
    """Whole days between each event and the anchor date of its key."""
    return events.join(anchors, key).withColumn(name, elapsed_days(anchor, ts))


def anchored_window(
    events: DataFrame,
    anchors: DataFrame,
    key: str,
    ts: str,
    anchor: str,
    lo: int | None = None,
    hi: int | None = None,
    name: str = "days",
    spread_days: int | None = None,
) -> DataFrame:
    """Events whose day offset from the anchor lies in [lo, hi].

    With ``spread_days`` events meet their anchors by key and by stretches of so
    many days, and an anchor goes to every stretch that its window touches, which
    must end on both sides: the events of one key then lie in many tasks, and
    those far from all anchors meet none.
    """
    if spread_days is None:
        out = with_offset(events, anchors, key, ts, anchor, name)
    else:
        if lo is None or hi is None:
            raise ValueError("spread_days needs a window with two ends")
        stretch, day = spread_days * DAY_MICROS, F.lit(DAY_MICROS)
        first = floor_div(micros(anchor) + lo * day, stretch)
        last = floor_div(micros(anchor) + (hi + 1) * day - 1, stretch)
        asked = anchors.withColumn("_stretch", F.explode(F.sequence(first, last)))
        placed = events.withColumn("_stretch", floor_div(micros(ts), stretch))
        met = placed.join(asked, [key, "_stretch"]).drop("_stretch")
        out = met.withColumn(name, elapsed_days(anchor, ts))
    if lo is not None:
        out = out.where(F.col(name) >= lo)
    if hi is not None:
        out = out.where(F.col(name) <= hi)
    return out


def explode_map(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    return df.select(*keys, F.explode(name).alias("time", value))


def key_outer(old: DataFrame, new: DataFrame, key: str, name: str = "daily_data") -> DataFrame:
    """Full outer join of two snapshots on (record, map key).

    The second join column spreads the entries of one record.
    """
    a = explode_map(old, [key], name, "old_value").withColumn("_old", F.lit(True))
    b = explode_map(new, [key], name, "new_value").withColumn("_new", F.lit(True))
    status = (
        F.when(F.col("_old").isNull(), "only_new")
        .when(F.col("_new").isNull(), "only_old")
        .otherwise("both")
    )
    joined = a.join(b, [key, "time"], "full_outer")
    return joined.withColumn("key_status", status).drop("_old", "_new")


def crosswalk(
    df: DataFrame, mapping: DataFrame, on: str, old: str, new: str, name: str | None = None
) -> DataFrame:
    """Replace one id system by another through a mapping table."""
    pairs = mapping.select(F.col(old).alias(on), F.col(new).alias("_new"))
    out = df.join(pairs, on, "left")
    if name and name != on:
        return out.withColumnRenamed("_new", name)
    return out.drop(on).withColumnRenamed("_new", on)


def replace_rows(df: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """Drop the keys of a fresh extract, then append the extract (SET2)."""
    return anti(df, new.select(key), key).unionByName(new, allowMissingColumns=True)


def union_aligned(
    frames: Sequence[DataFrame], renames: Sequence[Mapping[str, str]] | None = None
) -> DataFrame:
    """Union by name after renaming; a column absent on one side is NULL (SET1)."""
    renames = renames or [{} for _ in frames]
    first, *rest = [f.withColumnsRenamed(dict(r)) for f, r in zip(frames, renames)]
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
