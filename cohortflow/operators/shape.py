"""Aggregates, reshaping, sorting (AGG1 to AGG12, RSH1 to RSH3, SORT1, SORT2)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.operators.quantiles import exact_quantiles

# Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a NULL key form no group."""
    return reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)


def grouped(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Named aggregates per key, NULL keys left out."""
    out = [c.alias(name) for name, c in aggs.items()]
    return without_null_keys(df, keys).groupBy(*keys).agg(*out)


def distinct_count(
    df: DataFrame, keys: Sequence[str], entity: str, name: str = "n", approx: bool = False
) -> DataFrame:
    count = F.approx_count_distinct(entity) if approx else F.countDistinct(entity)
    return without_null_keys(df, keys).groupBy(*keys).agg(count.alias(name))


def pooled_moments(
    df: DataFrame, keys: Sequence[str], mean: str = "mean", sd: str = "std", n: str = "valid_data"
) -> DataFrame:
    """Mean and population SD of the pooled readings, from daily rows."""
    m, s, c = F.col(mean), F.col(sd), F.col(n)
    agg = grouped(
        df,
        keys,
        **{n: F.sum(c), "_m": F.sum(m * c), "_q": F.sum((s * s + m * m) * c)},
    )
    pooled = F.try_divide("_m", n)
    spread = F.try_divide("_q", n) - pooled * pooled
    return agg.select(
        *keys, n, pooled.alias(mean), F.sqrt(F.greatest(spread, F.lit(0.0))).alias(sd)
    )


def global_rate(df: DataFrame, a: str, b: str, name: str = "rate") -> DataFrame:
    """One row: 1 - sum(a) / sum(b)."""
    total_a, total_b = F.coalesce(F.sum(a), F.lit(0)), F.coalesce(F.sum(b), F.lit(0))
    return df.agg((1 - F.try_divide(total_a, total_b)).alias(name))


def value_counts(
    df: DataFrame, cols: Sequence[str], entity: str | None = None, name: str = "n"
) -> DataFrame:
    """Rows per value, or entities per value; rows with a NULL value are left out."""
    if entity:
        df = df.select(*dict.fromkeys([entity, *cols])).distinct()
    return without_null_keys(df, cols).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


# Quartile names.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def profile(df: DataFrame, name: str) -> DataFrame:
    """Count, mean, extremes and quartiles of a number, exact at any size; n is 0 without any."""
    numbers = df.select(F.col(name).cast("double").alias("_x"))
    basic = {"mean": F.avg("_x"), "min": F.min("_x"), "max": F.max("_x")}
    found = exact_quantiles(numbers, [], "_x", QUARTILES, also=basic)
    # Grouping by nothing gives one row for an empty frame too.
    rest = [F.any_value(c).alias(c) for c in (*basic, *QUARTILES)]
    return found.agg(F.coalesce(F.any_value("n"), F.lit(0)).alias("n"), *rest)


def profile_time(df: DataFrame, ts: str) -> DataFrame:
    """The same profile of a time, as timestamps."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    out = profile(df.select(seconds.alias("t")), "t")
    as_ts = [F.timestamp_seconds(F.col(c)).alias(c) for c in ("mean", "min", "max", *QUARTILES)]
    return out.select("n", *as_ts)


def median_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return exact_quantiles(df, keys, name, {"median": 0.5})


def first_by(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """First non-null value per key along ``order``."""
    known = df.where(F.col(key).isNotNull() & F.col(name).isNotNull())
    return known.groupBy(key).agg(F.min_by(name, order).alias(name))


def box_stats(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and n per group."""
    if not keys:
        raise ValueError("box_stats needs at least one key")
    return exact_quantiles(df, keys, name, QUARTILES, whiskers=True)


def trajectory(df: DataFrame, week: str, by: Sequence[str], name: str) -> DataFrame:
    """Mean per (week, arm...) with a normal 95 % interval."""
    half = Z95 * F.try_divide(F.stddev_samp(name), F.sqrt(F.count(name)))
    mean = F.avg(name)
    return grouped(
        df, [week, *by], n=F.count(name), mean=mean, ci_lo=mean - half, ci_hi=mean + half
    )


def _poisson_weight(u: Column) -> Column:
    """A Poisson number of mean 1 from a number in [0, 1): how often a resample has a row."""
    chain, total = None, 0.0
    for k in range(18):
        total += math.exp(-1.0) / math.factorial(k)
        chain = F.when(u < total, k) if chain is None else chain.when(u < total, k)
    return chain.otherwise(18)


def hashed_draw(ids: Sequence[str]) -> Callable[[Column], Column]:
    """Numbers in [0, 1) that depend on a row's ``ids`` and the replicate only."""
    return lambda replicate: F.shiftrightunsigned(F.xxhash64(*ids, replicate), 11) * 2.0**-53


def trajectory_bands(
    df: DataFrame,
    week: str,
    by: Sequence[str],
    name: str,
    ids: Sequence[str],
    replicates: int = 1000,
    level: float = 0.95,
    draw: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Mean per (week, arm...) with a bootstrap interval: percentiles of the means of resamples.

    Each resample counts a row a Poisson number of times, drawn from a hash of
    the row's ``ids`` and the number of the resample, so it is the same however
    the rows are laid out, and rows need not be brought together.  Rows meet all
    resamples in one pass; what is shuffled is one row per group and resample.
    A resample without rows is left out, NULL keys and values too.
    """
    draw = draw or hashed_draw(ids)
    known = without_null_keys(df, [week, *by, name]).withColumn("_y", F.col(name).cast("double"))
    # Each row becomes as many as there are resamples, so the rows are dealt out by their number, not
    # by their size: a given number of partitions is kept as it is.
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Replicate 0 has each row once: the mean itself.
    many = known.repartition(tasks).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # The draw is a column of its own and no filter follows it, so it is made once a row.
    drawn = many.withColumn("_u", draw(F.col("_r")))
    weight = F.when(F.col("_r") == 0, 1).otherwise(_poisson_weight(F.col("_u")))
    weighted = F.when(F.col("_w") > 0, F.col("_w") * F.col("_y"))
    sums = (
        drawn.select(week, *by, "_r", "_y", weight.alias("_w"))
        .groupBy(week, *by, "_r")
        .agg(F.sum("_w").alias("n"), F.try_divide(F.sum(weighted), F.sum("_w")).alias("_m"))
    )
    own, tail = F.col("_r") == 0, (1 - level) / 2
    resampled = F.when(~own, F.col("_m"))
    return sums.groupBy(week, *by).agg(
        F.max(F.when(own, F.col("n"))).alias("n"),
        F.max(F.when(own, F.col("_m"))).alias("mean"),
        F.percentile(resampled, F.lit(tail)).alias("ci_lo"),
        F.percentile(resampled, F.lit(1 - tail)).alias("ci_hi"),
    )


def histogram(df: DataFrame, name: str, width: float) -> DataFrame:
    """Counts in bins [start, start + width)."""
    start = (F.floor(F.col(name) / F.lit(float(width))) * width).alias("bin_start")
    return df.where(F.col(name).isNotNull()).groupBy(start).agg(F.count(F.lit(1)).alias("n"))


def count_pivot(
    df: DataFrame, rows: str, cols: str, entity: str, values: Sequence[object]
) -> DataFrame:
    """Distinct entities per row value, one column per listed column value.

    Duplicates go before the pivot, so both aggregates combine on the map side.
    """
    unique = without_null_keys(df, [rows]).select(rows, cols, entity).distinct()
    return unique.groupBy(rows).pivot(cols, list(values)).agg(F.count(entity))


def pivot_first(
    df: DataFrame,
    key: str,
    label: str,
    labels: Sequence[str],
    values: Sequence[str],
    order: str,
    sep: str = "_",
) -> DataFrame:
    """First non-null value in order per (key, label), as columns label + value."""

    def first(lab: str, value: str) -> Column:
        here = (F.col(label) == lab) & F.col(value).isNotNull()
        return F.min_by(F.col(value), F.when(here, F.col(order))).alias(f"{lab}{sep}{value}")

    known = df.where(F.col(label).isin(list(labels)) & F.col(key).isNotNull())
    return known.groupBy(key).agg(*[first(lab, v) for v in values for lab in labels])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    cast = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(list(ids), list(values), "variable", "value")


def explode_day_map(df: DataFrame, date: str, name: str) -> DataFrame:
    """Day maps to readings (date, time, glucose, ts), missing values dropped.

    A key may have a suffix after ``_`` that parts readings of one instant.
    """
    long = df.withColumn("_d", F.to_date(date)).select(
        *[c for c in df.columns if c not in (name, date)],
        F.col("_d").alias("date"),
        F.explode(name).alias("time", "glucose"),
    )
    clock = F.substring_index("time", "_", 1)
    when = F.concat_ws(" ", F.col("date").cast("string"), clock)
    return long.where(F.col("glucose").isNotNull()).withColumn("ts", when.try_cast("timestamp"))


def sort_by_category(
    df: DataFrame, name: str, order: Sequence[str], then: Sequence[str] = ()
) -> DataFrame:
    """Sort by a given order of categories; unlisted ones come last.

    Keys in ``then`` also spread one large category over the sort's ranges.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name))
    rank = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    return df.orderBy(rank, *then)


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def key_sets(df: DataFrame, old: str, new: str) -> DataFrame:
    """Union, difference and intersection of two key arrays in a row (SET3)."""
    a, b = F.col(old), F.col(new)
    return df.withColumns(
        {
            "key_union": F.array_sort(F.array_union(a, b)),
            "key_added": F.array_sort(F.array_except(b, a)),
            "key_missing": F.array_sort(F.array_except(a, b)),
            "key_common": F.array_sort(F.array_intersect(a, b)),
        }
    )


def rounded(df: DataFrame, digits: Mapping[str, int] | int = 6) -> DataFrame:
    """Round double columns, all alike or by name."""

    def one(name: str, kind: str) -> Column:
        if kind not in ("double", "float"):
            return F.col(name)
        d = digits if isinstance(digits, int) else digits.get(name, 6)
        return (F.round(F.col(name), d) + F.lit(0.0)).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])
