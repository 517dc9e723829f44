"""Scalar expressions (FN1 to FN7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

# Adult body mass classes (WS/T 428-2013), lower cut inclusive.
BMI_CUTS = (18.5, 24.0, 28.0)
BMI_CLASSES = ("underweight", "normal", "overweight", "obese")

# Fixed value: a glucose reading in mmol/L counts as valid from here on.
VALID_FROM = 1.1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(value: Column, by: int) -> Column:
    """Floor division of whole numbers, exact for any bigint."""
    by = F.lit(by).cast("bigint")
    return ((value - F.pmod(value, by)) / by).cast("bigint")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, rounded down: two hours before is -1."""
    return floor_div(micros(end) - micros(start), DAY_MICROS).cast("int")


def week_index(days: Column | str) -> Column:
    """Week number of a day offset, from 0; negative offsets round down."""
    return floor_div(col(days).cast("bigint"), 7).cast("int")


def bmi(weight_kg: Column | str, height_cm: Column | str) -> Column:
    metres = col(height_cm) / F.lit(100.0)
    return F.try_divide(col(weight_kg), metres * metres)


def bmi_class(
    value: Column | str,
    cuts: Sequence[float] = BMI_CUTS,
    labels: Sequence[str] = BMI_CLASSES,
) -> Column:
    value = col(value)
    out = F.when(value < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(value < cut, label)
    return out.when(value.isNotNull(), labels[-1])


def fmt_pct(value: Column | str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", col(value) * 100.0)


def fmt_fixed(value: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(value).cast("double"))


def parse_day_map(text: Column | str) -> Column:
    """Decode ``{"HH:MM:SS": glucose}`` written as JSON or as a Python literal.

    Missing values (None, nan) become NULL entries, other text a NULL map.
    """
    as_json = F.regexp_replace(col(text), r":\s*(?:None|nan|NaN)\b", ": null")
    return F.from_json(as_json, "map<string,double>")


def count_below(day_map: Column | str, limit: float = VALID_FROM) -> Column:
    """Entries under the limit; 0 where there is no map."""
    m = col(day_map)
    low = F.map_filter(m, lambda _, v: v < F.lit(limit))
    return F.when(m.isNull(), F.lit(0)).otherwise(F.size(low))


def last_key(day_map: Column | str) -> Column:
    return F.array_max(F.map_keys(col(day_map)))


def first_key(day_map: Column | str) -> Column:
    return F.array_min(F.map_keys(col(day_map)))


def round_tenth(v: Column) -> Column:
    """One decimal of the binary value, half to even, as Python's round does.

    10 v is the sum of 8 v and 2 v, whose rounding error is known; compared with
    the odd number between two results, the sum decides, or at a tie its error.
    """
    high, low = v * 8.0, v * 2.0
    s = high + low
    t = s - high
    error = (high - (s - t)) + (low - t)
    whole = F.floor(s).cast("double")
    below = F.when((s == whole) & (error < 0), whole - 1).otherwise(whole)
    gap = 2 * s - (2 * below + 1)
    side = F.when(gap != 0, gap).otherwise(error)
    even = F.pmod(below, F.lit(2.0))
    up = F.when(side > 0, F.lit(1.0)).when(side < 0, F.lit(0.0)).otherwise(even)
    return F.when(F.abs(v) < 1e14, (below + up) / 10.0).otherwise(v)
