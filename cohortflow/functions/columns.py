"""Projections, predicates and column rules (SEL1 to SEL11)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalars import col


def rename_columns(
    df: DataFrame, mapping: Mapping[str, str], drop: Sequence[str] = ()
) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(mapping))


def select_like(df: DataFrame, pattern: str, first: Sequence[str] = ()) -> DataFrame:
    """Key columns first, then every column whose name matches."""
    found = [c for c in df.columns if re.search(pattern, c) and c not in first]
    return df.select(*first, *found)


def flag_contains(
    name: Column | str, token: str, except_: Sequence[str] = ()
) -> Column:
    """The name holds the token and is not one of the listed exceptions."""
    flag = col(name).contains(token)
    return flag & ~col(name).isin(list(except_)) if except_ else flag


def flag_either(
    c1: Column | str, c2: Column | str, token: str, mode: str = "either"
) -> Column:
    """Token test over two columns.

    ``first``: the first column that is present decides.  ``either``: true when
    one of them has the token, false otherwise, never NULL.
    """
    a, b = col(c1).contains(token), col(c2).contains(token)
    if mode == "first":
        return F.coalesce(a, b)
    if mode != "either":
        raise ValueError(f"unknown mode {mode}")
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def to_ts(df: DataFrame, cols: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Cast columns to timestamps; text that is no time becomes NULL."""
    parse = (
        (lambda c: F.try_to_timestamp(F.col(c), F.lit(fmt)))
        if fmt
        else (lambda c: F.col(c).try_cast("timestamp"))
    )
    return df.withColumns({c: parse(c) for c in cols})


def to_day(df: DataFrame, ts: str, name: str) -> DataFrame:
    """Cut the time of day off."""
    return df.withColumn(name, F.to_date(ts))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def rejected_keys(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys of the rows that ``complete_cases`` removes."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.where(missing).select(key).distinct()


def fill_from(df: DataFrame, name: str, fallback: Column | str | float | bool) -> DataFrame:
    """Fill gaps from another column (by name or expression) or a constant."""
    by_column = isinstance(fallback, Column) or (
        isinstance(fallback, str) and fallback in df.columns
    )
    other = col(fallback) if by_column else F.lit(fallback)
    return df.withColumn(name, F.coalesce(F.col(name), other))


def recode(
    df: DataFrame, name: str, mapping: Mapping[object, object], other: str = "null"
) -> DataFrame:
    """Replace values by a lookup; unlisted values become NULL or are kept."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), F.col(name))
    return df.withColumn(name, F.coalesce(found, F.col(name)) if other == "keep" else found)


def label_when(
    df: DataFrame, name: str, cases: Sequence[tuple[Column, object]], default: object = None
) -> DataFrame:
    """First condition that holds gives the label; NULL conditions do not hold."""
    first, *rest = cases
    out = F.when(first[0], F.lit(first[1]))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return df.withColumn(name, out.otherwise(F.lit(default)))


# Number of valid weeks, as bands.
WEEK_EDGES = (0, 2, 4, 8, 12, float("inf"))
WEEK_LABELS = ("<=2", "3-4", "5-8", "9-12", ">=13")


def bin_label(
    value: Column | str,
    edges: Sequence[float] = WEEK_EDGES,
    labels: Sequence[str] = WEEK_LABELS,
) -> Column:
    """Right-closed bins, the lowest edge included; NULL outside of them."""
    v = col(value)
    out = F.when((v < edges[0]) | (v > edges[-1]), F.lit(None).cast("string"))
    for top, label in zip(edges[1:], labels):
        out = out.when(v <= F.lit(top), label)
    return out
