"""Glucose metrics (CGM1 to CGM6).

The reference reads its daily table ready-made and its metric class is unseen, so
the definitions below are those of the published literature:
time in range bands of the international consensus (Battelino 2019), the
glycaemia risk index (Klonoff 2022), the low and high blood glucose index
(Kovatchev 1997, mmol/L form), MAG (Hermanides 2010) and MAGE (Service 1970).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.functions.scalars import VALID_FROM, col, elapsed_days, floor_div, micros, week_index
from cohortflow.operators.joins import anchored_window, keep_keys
from cohortflow.operators.ordered import time_chunk
from cohortflow.operators.quantiles import exact_quantiles

# Band limits in mmol/L.
VERY_LOW, LOW, HIGH, VERY_HIGH, TIGHT_HIGH = 3.0, 3.9, 10.0, 13.9, 7.8
# Readings of a full day, one a minute.
PER_DAY = 1440
# The metrics of the weekly report, in report order.
WEEKLY_METRICS = (
    "TBR", "TBR_II", "TAR", "TAR_II", "TIR", "GRI", "lbgi", "hbgi", "mean", "std", "cv",
)


def risk_scale(glucose: Column | str) -> Column:
    """Symmetrised glucose: below zero on the low side, above on the high side."""
    return 1.794 * (F.pow(F.ln(col(glucose)), F.lit(1.026)) - 1.861)


def _tally(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _bands(g: Column) -> dict[str, Column]:
    return {
        "vlow": _tally(g < VERY_LOW),
        "low": _tally((g >= VERY_LOW) & (g < LOW)),
        "high": _tally((g > HIGH) & (g <= VERY_HIGH)),
        "vhigh": _tally(g > VERY_HIGH),
        "in_range_tight": _tally((g >= LOW) & (g <= TIGHT_HIGH)),
    }


def _risk(g: Column) -> dict[str, Column]:
    f = risk_scale(g)
    risk = 10 * f * f
    return {
        "lbgi": F.avg(F.when(f < 0, risk).when(g.isNotNull(), 0.0)),
        "hbgi": F.avg(F.when(f > 0, risk).when(g.isNotNull(), 0.0)),
    }


def daily_summary(
    readings: DataFrame, key: str = "patient_id", valid_from: float = VALID_FROM
) -> DataFrame:
    """One row per patient-day; every measure but ``data_count`` is over valid readings."""
    g = F.when(F.col("glucose") >= valid_from, F.col("glucose"))
    measures = {
        "data_count": F.count("glucose"),
        "valid_data": F.count(g),
        "mean": F.avg(g),
        "std": F.stddev_pop(g),
        **_bands(g),
        **_risk(g),
    }
    daily = (
        readings.where(F.col(key).isNotNull())
        .groupBy(key, F.to_date("ts").alias("date"))
        .agg(*[c.alias(n) for n, c in measures.items()])
    )
    # At most one row per calendar day and patient is left here.
    return daily.withColumn("first_date", F.min("date").over(Window.partitionBy(key)))


def with_week(daily: DataFrame) -> DataFrame:
    return daily.where("valid_data > 0").withColumn(
        "week", week_index(elapsed_days("first_date", "date"))
    )


def weekly_rollup(
    daily: DataFrame,
    key: str = "patient_id",
    per_day: int = PER_DAY,
    min_valid: int | None = None,
) -> DataFrame:
    """Weekly sums, pooled moments and ratios per patient.

    With ``min_valid`` only weeks with that many valid readings stay, and
    ``week_count`` tells how many of them the patient has.  Both come from the
    weekly rows themselves, so the daily rows are shuffled once.
    """
    n, m, s = F.col("valid_data"), F.col("mean"), F.col("std")
    sums = {
        "valid_data": F.sum(n),
        **{b: F.sum(b) for b in ("vlow", "low", "high", "vhigh", "in_range_tight")},
        "_m": F.sum(m * n),
        "_q": F.sum((s * s + m * m) * n),
        "_l": F.sum(F.col("lbgi") * n),
        "_h": F.sum(F.col("hbgi") * n),
    }
    weekly = (
        with_week(daily)
        .groupBy(key, "week")
        .agg(*[c.alias(name) for name, c in sums.items()])
    )
    if min_valid is not None:
        weekly = weekly.where(F.col("valid_data") >= min_valid).withColumn(
            "week_count", F.count(F.lit(1)).over(Window.partitionBy(key))
        )
    mean = F.col("_m") / n
    std = F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)))
    vlow, low, high, vhigh = (F.col(b) for b in ("vlow", "low", "high", "vhigh"))
    ratios = {
        "mean": mean,
        "std": std,
        "cv": F.try_divide(std, mean),
        "lbgi": F.col("_l") / n,
        "hbgi": F.col("_h") / n,
        "TIR": (n - vlow - low - high - vhigh) / n,
        "TBR": (low + vlow) / n,
        "TBR_II": vlow / n,
        "TAR": (high + vhigh) / n,
        "TAR_II": vhigh / n,
        "GRI": (3.0 * vlow + 2.4 * low + 1.6 * vhigh + 0.8 * high) / n,
        "valid_rate": n / F.lit(per_day * 7),
    }
    return weekly.withColumns(ratios).drop("_m", "_q", "_l", "_h")


def valid_weeks(
    daily: DataFrame, min_valid: int = PER_DAY * 5, key: str = "patient_id"
) -> DataFrame:
    """Daily rows of weeks with enough valid readings, with the number of such weeks."""
    days = with_week(daily)
    weeks = (
        days.groupBy(key, "week")
        .agg(F.sum("valid_data").alias("week_valid_sum"))
        .where(F.col("week_valid_sum") >= min_valid)
        .withColumn("week_count", F.count(F.lit(1)).over(Window.partitionBy(key)))
    )
    return keep_keys(days, weeks, [key, "week"])


def wear_rate(
    daily: DataFrame, key: str = "patient_id", per_day: int = PER_DAY
) -> DataFrame:
    """Share of the possible readings that are valid, per patient."""
    rate = F.col("data_valid") / (F.col("days") * per_day)
    return (
        daily.where("valid_data > 0")
        .groupBy(key)
        .agg(F.countDistinct("date").alias("days"), F.sum("valid_data").alias("data_valid"))
        .withColumn("data_valid_rate", rate)
    )


def mean_wear_rate(rates: DataFrame) -> DataFrame:
    return rates.agg(F.avg("data_valid_rate").alias("mean_rate"))


def _runs(cut: DataFrame, key: str) -> DataFrame:
    """Monotone runs inside each chunk of the time line, numbered from 0.

    A run holds its direction (NULL without a change), the sum of its absolute
    steps and its first and last reading; equal neighbours do not end a run.
    """
    w = Window.partitionBy(key, "chunk").orderBy("ts", "reading_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reading = F.struct("ts", "reading_id", "glucose")
    return (
        cut.withColumn("step", F.col("glucose") - F.lag("glucose").over(w))
        .withColumn("up", F.when(F.col("step") > 0, True).when(F.col("step") < 0, False))
        .withColumn("was_up", F.last("up", ignorenulls=True).over(before))
        .withColumn("turned", F.when(F.col("up") != F.col("was_up"), 1).otherwise(0))
        .withColumn("run", F.sum("turned").over(upto))
        .groupBy(key, "chunk", "run")
        .agg(
            F.max("up").alias("up"),
            F.coalesce(F.sum(F.abs("step")), F.lit(0.0)).alias("amplitude"),
            F.min(reading).alias("head"),
            F.max(reading).alias("tail"),
        )
        .withColumn("last_run", F.max("run").over(Window.partitionBy(key, "chunk")))
    )


def excursions(cut: DataFrame, key: str = "patient_id") -> DataFrame:
    """Amplitude of every monotone run between two turning points, per patient.

    ``cut`` holds readings with the chunk of the time line.  Runs inside a chunk are
    final.  The first and the last run of a chunk may go on in its neighbours, so
    these and the step into the chunk, at most three rows for a chunk, are joined
    up in a pass over the patient.  Every patient has a row, be it of amplitude 0.
    """
    runs = _runs(cut, key)
    at_edge = (F.col("run") == 0) | (F.col("run") == F.col("last_run"))
    closed = runs.where(~at_edge).select(key, "amplitude")
    piece = F.struct("up", "amplitude")
    chunks = runs.where(at_edge).groupBy(key, "chunk").agg(
        F.max("last_run").alias("last_run"),
        F.max(F.when(F.col("run") == 0, piece)).alias("first"),
        F.max(F.when(F.col("run") > 0, piece)).alias("last"),
        F.min("head").alias("head"),
        F.max("tail").alias("tail"),
    )
    # One row per chunk that holds readings: bounded by the length of the time line.
    along = Window.partitionBy(key).orderBy("chunk")
    link = F.col("head.glucose") - F.lag("tail.glucose").over(along)
    step = F.struct((F.col("link") > 0).alias("up"), F.abs("link").alias("amplitude"))
    pieces = F.posexplode(F.array(F.when(F.col("link") != 0, step), "first", "last"))
    edges = (
        chunks.withColumn("link", link)
        .select(key, "chunk", "last_run", pieces.alias("pos", "piece"))
        .select(key, "chunk", "last_run", "pos", "piece.up", "piece.amplitude")
        .where(F.col("amplitude").isNotNull())
    )
    # With three runs or more in a chunk a closed run lies between its first and
    # its last one, so these never join up, even in the same direction.
    ordered = Window.partitionBy(key).orderBy("chunk", "pos")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.col("pos") == 2) & (F.col("last_run") > 1)
    was_up = F.last("up", ignorenulls=True).over(before)
    turned = F.when(apart | (F.col("up") != was_up), 1).otherwise(0)
    joined = (
        edges.withColumn("turned", turned)
        .withColumn("run", F.sum("turned").over(upto))
        .groupBy(key, "run")
        .agg(F.sum("amplitude").alias("amplitude"))
    )
    return closed.unionByName(joined.select(key, "amplitude"))


def patient_metrics(
    readings: DataFrame,
    key: str = "patient_id",
    valid_from: float = VALID_FROM,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Glycaemic metrics per patient over the valid readings.

    MAG is the sum of absolute steps per hour of wear.  MAGE is the mean of the
    excursions that exceed one SD, NULL when there is none.  Measures of spread
    are NULL for a patient with fewer than two readings.

    Two scans run: one for the moments, which combine on the map side, and one that
    lays the readings out by patient and chunk for the excursions.
    """
    valid = readings.where((F.col("glucose") >= valid_from) & F.col(key).isNotNull())
    g = F.col("glucose")
    moments = valid.groupBy(key).agg(
        F.count(g).alias("n"),
        F.avg(g).alias("mean"),
        F.stddev_samp(g).alias("sd"),
        *[c.alias(name) for name, c in _bands(g).items()],
        *[c.alias(name) for name, c in _risk(g).items()],
        ((F.max(micros("ts")) - F.min(micros("ts"))) / 3.6e9).alias("hours"),
    )
    chunk = time_chunk("ts", chunk_seconds).alias("chunk")
    cut = valid.select(key, "ts", "reading_id", "glucose", chunk)
    large = F.when(F.col("amplitude") > F.col("sd"), F.col("amplitude"))
    base = (
        excursions(cut, key)
        .join(moments, key)
        .groupBy(key)
        .agg(
            *[F.any_value(c).alias(c) for c in moments.columns if c != key],
            F.sum("amplitude").alias("path"),
            F.avg(large).alias("MAGE"),
        )
    )
    n, vlow, low, high, vhigh = (F.col(c) for c in ("n", "vlow", "low", "high", "vhigh"))
    several = F.col("n") >= 2
    return base.select(
        key,
        "n",
        "mean",
        F.when(several, F.col("sd")).alias("sd"),
        F.when(several, F.try_divide("sd", "mean")).alias("cv"),
        ((n - vlow - low - high - vhigh) / n).alias("TIR"),
        ((vlow + low) / n).alias("TBR"),
        ((high + vhigh) / n).alias("TAR"),
        ((3.0 * vlow + 2.4 * low + 1.6 * vhigh + 0.8 * high) / n).alias("GRI"),
        "lbgi",
        "hbgi",
        F.when(several, F.try_divide("path", "hours")).alias("MAG"),
        "MAGE",
    )


def first_days(
    readings: DataFrame,
    anchors: DataFrame,
    days: int = 7,
    key: str = "patient_id",
    anchor: str = "enroll_ts",
) -> DataFrame:
    """Readings of the first days after enrolment."""
    return anchored_window(readings, anchors, key, "ts", anchor, 0, days - 1, "enroll_days")


# The percentiles of an ambulatory glucose profile.
AGP_PERCENTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def agp(
    readings: DataFrame,
    keys: Sequence[str] = ("patient_id",),
    bin_minutes: int = 15,
    valid_from: float = VALID_FROM,
    approx: bool = False,
) -> DataFrame:
    """Ambulatory glucose profile: percentiles and time in range per time-of-day bin.

    Percentiles are exact and no state holds the values of a bin; ``approx`` asks
    for a sketch of fixed size instead.  Rows with a NULL key form no profile.
    """
    g = F.col("glucose")
    seconds = F.pmod(floor_div(micros("ts"), 1_000_000), F.lit(86400))
    valid = readings.where(g >= valid_from).withColumn(
        "bin", floor_div(seconds, bin_minutes * 60).cast("int")
    )
    by = [*keys, "bin"]
    in_range = F.avg(g.between(LOW, HIGH).cast("int"))
    if approx:
        probs = F.array(*[F.lit(p) for p in AGP_PERCENTILES.values()])
        sketch = F.percentile_approx("glucose", probs, 10000).alias("_p")
        points = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), sketch, in_range.alias("in_range"))
        columns = [F.col("_p")[i].alias(p) for i, p in enumerate(AGP_PERCENTILES)]
        return points.select(*by, "n", *columns, "in_range")
    return exact_quantiles(valid, by, "glucose", AGP_PERCENTILES, also={"in_range": in_range})
