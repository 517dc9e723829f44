"""Revision audit between two snapshots of the same day records (REV1 to REV5).

Both snapshots meet in one join on the record id.  Everything after it works on
the two maps inside the row, so no further shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalars import VALID_FROM, count_below, first_key, last_key, round_tenth

# Fixed value: up to this many keys after the old end are normal late arrival.
TAIL_MIN = 3


def snapshot_pair(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old records with their new version; NULL where there is none."""
    a = old.select(key, F.col("daily_data").alias("old_map"))
    b = new.select(key, F.col("daily_data").alias("new_map"), F.lit(True).alias("in_new"))
    return a.join(b, key, "left").withColumn("in_new", F.coalesce("in_new", F.lit(False)))


def snapshot_delta(pairs: DataFrame, limit: float = VALID_FROM) -> DataFrame:
    """Invalid counts on both sides; a record absent from the new side has changed."""
    new_count = F.when(F.col("in_new"), count_below("new_map", limit))
    delta = F.col("invalid_new") - F.col("invalid_old")
    return (
        pairs.withColumn("invalid_old", count_below("old_map", limit))
        .withColumn("invalid_new", new_count)
        .withColumn("invalid_delta", delta)
        .withColumn("delta_changed", ~F.col("invalid_delta").eqNullSafe(F.lit(0)))
    )


def _boxed(m: Column) -> Column:
    """Values rounded to one decimal, each in a struct, so a NULL value differs from no key."""
    return F.transform_values(m, lambda _, v: F.struct(round_tenth(v).alias("v")))


def _zipped(old: str, new: str) -> Column:
    """Entries (key, old, new) over the union of both key sets."""
    both = F.map_zip_with(
        _boxed(F.col(old)),
        _boxed(F.col(new)),
        lambda _, a, b: F.struct(a.alias("old"), b.alias("new")),
    )
    return F.map_entries(both)


def map_diff(
    df: DataFrame,
    old: str = "old_map",
    new: str = "new_map",
    tail_min: int = TAIL_MIN,
    strict_reference: bool = False,
) -> DataFrame:
    """Keys added and missing and values changed up to the old side's last key.

    ``tail`` counts later keys, and only when there are more than ``tail_min``.
    With ``strict_reference`` the key count is zero whenever the tail is not
    counted, whatever keys were added or lost.
    """
    a, b = F.col(old), F.col(new)
    comparable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0)
    entries = F.col("_entries")
    end = F.col("old_end")
    upto = F.filter(entries, lambda e: e["key"] <= end)
    added = F.filter(upto, lambda e: e["value"]["old"].isNull())
    missing = F.filter(upto, lambda e: e["value"]["new"].isNull())
    moved = F.filter(
        upto,
        lambda e: e["value"]["old"].isNotNull()
        & e["value"]["new"].isNotNull()
        & ~e["value"]["old"]["v"].eqNullSafe(e["value"]["new"]["v"]),
    )
    later = F.size(F.filter(entries, lambda e: e["key"] > end))
    no_keys = F.array().cast("array<string>")
    no_values = F.array().cast("array<struct<time:string,old_value:double,new_value:double>>")

    def keys_of(found: Column) -> Column:
        return F.array_sort(F.transform(found, lambda e: e["key"]))

    detail = F.array_sort(
        F.transform(
            moved,
            lambda e: F.struct(
                e["key"].alias("time"),
                e["value"]["old"]["v"].alias("old_value"),
                e["value"]["new"]["v"].alias("new_value"),
            ),
        )
    )
    n_added, n_missing, tail = (
        F.size("key_added"),
        F.size("key_missing"),
        F.col("key_delay"),
    )
    key_count = n_added + n_missing + tail
    if strict_reference:
        key_count = F.when(tail > tail_min, key_count).otherwise(0)
    # Without two maps to compare, only presence and emptiness can differ.
    differs = ~(a.isNull().eqNullSafe(b.isNull())) | F.coalesce(F.size(b) > 0, F.lit(False))
    any_change = (F.size("key_added") + F.size("key_missing") + F.size("value_changed") > 0) | (
        tail > tail_min
    )
    return (
        df.withColumn("_ok", comparable)
        .withColumn("old_end", F.when(F.col("_ok"), last_key(old)))
        .withColumn("new_end", F.when(F.col("_ok"), last_key(new)))
        .withColumn("_entries", F.when(F.col("_ok"), _zipped(old, new)))
        .withColumn("key_added", F.coalesce(keys_of(added), no_keys))
        .withColumn("key_missing", F.coalesce(keys_of(missing), no_keys))
        .withColumn("value_changed", F.coalesce(detail, no_values))
        .withColumn(
            "key_delay", F.when(F.col("_ok") & (later > tail_min), later).otherwise(F.lit(0))
        )
        .withColumn("key_changed_cnt", key_count)
        .withColumn("value_changed_cnt", F.size("value_changed"))
        .withColumn("changed", F.when(F.col("_ok"), any_change).otherwise(differs))
        .drop("_ok", "_entries")
    )


def diff_totals(diff: DataFrame) -> DataFrame:
    """Rows changed, rows with key changes, rows with value changes."""

    def rows(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")

    return diff.agg(
        F.count(F.lit(1)).alias("records"),
        rows(F.col("changed")).alias("changed_rows"),
        rows(F.col("key_changed_cnt") > 0).alias("key_rows"),
        rows(F.col("value_changed_cnt") > 0).alias("value_rows"),
    )


def map_diff_long(
    df: DataFrame,
    key: str = "id",
    old: str = "old_map",
    new: str = "new_map",
    before_local_end: bool = True,
    only_changed: bool = False,
) -> DataFrame:
    """One row per key of either map, for records where both sides are maps.

    The status goes by values, as in the reference: a key whose value is missing
    on one side counts as absent there.
    """
    both = df.where(F.col(old).isNotNull() & F.col(new).isNotNull())
    long = both.select(key, last_key(old).alias("_end"), F.explode(_zipped(old, new)).alias("e"))
    long = long.select(
        key,
        "_end",
        F.col("e.key").alias("time"),
        F.col("e.value.old.v").alias("old_value"),
        F.col("e.value.new.v").alias("new_value"),
    )
    if before_local_end:
        long = long.where(F.col("_end").isNull() | (F.col("time") <= F.col("_end")))
    a, b = F.col("old_value"), F.col("new_value")
    status = F.when(a.isNull(), "only_new").when(b.isNull(), "only_old").otherwise("both")
    out = (
        long.drop("_end")
        .withColumn("key_status", status)
        .withColumn("value_changed", a.isNotNull() & b.isNotNull() & (a != b))
        .withColumn("value_delta", b - a)
    )
    if only_changed:
        out = out.where((F.col("key_status") != "both") | F.coalesce("value_changed", F.lit(False)))
    return out


def snapshot_extent(df: DataFrame, old: str = "old_map", new: str = "new_map") -> DataFrame:
    """First and last key over both snapshots, and the last old key, per row."""
    return df.withColumns(
        {
            "first_time": F.least(first_key(old), first_key(new)),
            "last_time": F.greatest(last_key(old), last_key(new)),
            "old_last_time": last_key(old),
        }
    )
