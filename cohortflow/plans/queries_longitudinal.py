"""Queries over aggregates, windows, glucose metrics, cohort rules and audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators import cgm, quality, revision, shape, windows
from cohortflow.operators.ordered import time_chunk
from cohortflow.operators.shape import rounded
from cohortflow.functions.scalars import count_below
from cohortflow.plans import bindings as B
from cohortflow.plans import jobs
from cohortflow.plans.bindings import with_frames
from cohortflow.plans.registry import day_sql, day_text, query, r, ts_sql, ts_text
from cohortflow.session import cut_lineage
from cohortflow.sources import tables as T


def weekly(spark: SparkSession, base: str, min_valid: int | None = B.MIN_VALID) -> DataFrame:
    return cgm.weekly_rollup(B.daily(spark, base), per_day=B.PER_DAY, min_valid=min_valid)


# Aggregates.


@query(
    "AGG1_grouped",
    with_frames(
        """SELECT patient_id, count(glucose) AS n, round(sum(glucose), 4) AS total,
        round(avg(glucose), 8) AS mean, min(glucose) AS lo, max(glucose) AS hi FROM readings GROUP BY 1""",
        "readings",
    ),
)
def grouped(spark: SparkSession, base: str) -> DataFrame:
    g = F.col("glucose")
    df = shape.grouped(
        B.readings(spark, base), ["patient_id"], n=F.count(g), total=F.sum(g), mean=F.avg(g), lo=F.min(g), hi=F.max(g)
    )
    return rounded(df, {"total": 4, "mean": 8})


@query(
    "AGG2_distinct_count",
    """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days
    FROM events GROUP BY 1""",
)
def distinct_counts(spark: SparkSession, base: str) -> DataFrame:
    ev = T.load(spark, base, "events").withColumn("day", F.to_date("ts"))
    users = shape.distinct_count(ev, ["event_type"], "user_id", "users")
    return users.join(shape.distinct_count(ev, ["event_type"], "day", "days"), "event_type")


@query(
    "AGG3_pooled_moments",
    with_frames(
        """SELECT patient_id, valid_data, round(mean, 8) AS mean,
        round(sqrt(greatest(q / valid_data - mean * mean, 0)), 4) AS std
        FROM (SELECT patient_id, CAST(sum(valid_data) AS BIGINT) AS valid_data,
            sum(mean * valid_data) / sum(valid_data) AS mean,
            sum((std * std + mean * mean) * valid_data) AS q FROM daily_valid GROUP BY 1)""",
        "daily_valid",
    ),
)
def pooled(spark: SparkSession, base: str) -> DataFrame:
    daily = B.daily(spark, base).where("valid_data > 0")
    return rounded(shape.pooled_moments(daily, ["patient_id"]), {"mean": 8, "std": 4})


@query(
    "AGG4_global_rate",
    with_frames("SELECT round(1 - sum(valid_data) / sum(data_count), 6) AS rate FROM daily", "daily"),
)
def global_rate(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shape.global_rate(B.daily(spark, base), "valid_data", "data_count"))


@query(
    "AGG5_value_counts",
    with_frames(
        """SELECT exposed, status, city, count(DISTINCT patient_id) AS n FROM orders_f
        JOIN patients USING (patient_id) WHERE exposed IS NOT NULL GROUP BY 1, 2, 3""",
        "orders_f",
        "patients",
    ),
)
def value_counts(spark: SparkSession, base: str) -> DataFrame:
    df = B.orders_f(spark, base).join(B.patients(spark, base), "patient_id")
    return shape.value_counts(df, ["exposed", "status", "city"], entity="patient_id")


@query(
    "AGG6_profile",
    """SELECT count(*) AS n, strftime(to_timestamp(round(avg(e))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS mean,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max,
    strftime(to_timestamp(floor(quantile_cont(e, 0.25))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS q1,
    strftime(to_timestamp(floor(quantile_cont(e, 0.5))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS median,
    strftime(to_timestamp(floor(quantile_cont(e, 0.75))) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS q3
    FROM (SELECT ts, epoch_us(ts) / 1e6::DOUBLE AS e FROM events)""",
)
def profile(spark: SparkSession, base: str) -> DataFrame:
    df = shape.profile_time(T.load(spark, base, "events"), "ts")
    mean = F.date_format(F.timestamp_seconds(F.round(F.unix_micros("mean") / 1e6)), "yyyy-MM-dd HH:mm:ss")
    rest = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("min", "max", "q1", "median", "q3")]
    return df.select("n", mean.alias("mean"), *rest)


@query(
    "AGG6_profile_number",
    """SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS min,
    max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
    round(quantile_cont(o_totalprice, 0.5), 4) AS median,
    round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders""",
)
def profile_number(spark: SparkSession, base: str) -> DataFrame:
    df = shape.profile(T.load(spark, base, "orders"), "o_totalprice")
    return rounded(df, {"mean": 2, "q1": 4, "median": 4, "q3": 4})


@query(
    "AGG7_median_count",
    with_frames(
        "SELECT week, count(TIR) AS n, round(median(TIR), 6) AS median FROM weekly WHERE week <= 12 GROUP BY 1",
        "weekly",
    ),
)
def median_count(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shape.median_count(weekly(spark, base).where("week <= 12"), ["week"], "TIR"))


@query(
    "AGG8_first_by",
    with_frames(
        "SELECT patient_id, round(min_by(y, week), 6) AS y FROM weekly_outcome GROUP BY 1", "weekly_outcome"
    ),
)
def first_by(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shape.first_by(B.weekly_outcome(spark, base), "patient_id", "week", "y"))


def box_sql(keys: str, frame: str, value: str) -> str:
    on = " AND ".join(f"b.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    by = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {by}, b.n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
        round(min(x.{value}), 6) AS whisker_lo, round(max(x.{value}), 6) AS whisker_hi
        FROM (SELECT {keys}, count({value}) AS n, quantile_cont({value}, 0.25) AS q1,
            quantile_cont({value}, 0.5) AS med, quantile_cont({value}, 0.75) AS q3
            FROM {frame} GROUP BY {keys}) b JOIN {frame} x ON {on}
        AND x.{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
        GROUP BY {by}, b.n, q1, med, q3"""


@query("AGG9_box_stats", with_frames(box_sql("week", "weekly", "TIR"), "weekly"))
def box_stats(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shape.box_stats(cut_lineage(weekly(spark, base)), ["week"], "TIR"))


@query(
    "AGG10_trajectory",
    with_frames(
        """SELECT week, arm, count(y) AS n, round(avg(y), 6) AS mean,
        round(avg(y) - 1.959963984540054::DOUBLE * stddev_samp(y) / sqrt(count(y)), 6) AS ci_lo,
        round(avg(y) + 1.959963984540054::DOUBLE * stddev_samp(y) / sqrt(count(y)), 6) AS ci_hi
        FROM weekly_outcome GROUP BY 1, 2""",
        "weekly_outcome",
    ),
)
def trajectory(spark: SparkSession, base: str) -> DataFrame:
    return rounded(shape.trajectory(B.weekly_outcome(spark, base), "week", ["arm"], "y"))


# The same numbers in both engines: the first 8 hexadecimal digits of a digest of row and replicate.
REPLICATES = 200
_ROW_TEXT = "concat_ws(':', patient_id, week, {r})"
DRAW_SQL = f"CAST('0x' || substr(md5({_ROW_TEXT.format(r='r')}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
POISSON_SQL = " + ".join(
    f"(u >= {sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE)::INTEGER" for k in range(18)
)


def digest_draw(replicate: Column) -> Column:
    digest = F.md5(F.concat_ws(":", "patient_id", "week", replicate.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


@query(
    "AGG10_trajectory_bands",
    with_frames(
        f"""SELECT week, arm, any_value(n) AS n, round(any_value(mean), 6) AS mean,
        round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi
        FROM resampled JOIN (SELECT week, arm, count(*) AS n, avg(y) AS mean FROM weekly_outcome GROUP BY 1, 2)
        USING (week, arm) GROUP BY 1, 2""",
        "weekly_outcome",
        extra={
            "drawn": f"SELECT *, {DRAW_SQL} AS u FROM weekly_outcome, range(1, {REPLICATES + 1}) t(r)",
            "resampled": f"""SELECT week, arm, r, sum(w * y) / sum(w) AS m
            FROM (SELECT *, {POISSON_SQL} AS w FROM drawn) WHERE w > 0 GROUP BY 1, 2, 3""",
        },
    ),
)
def trajectory_bands(spark: SparkSession, base: str) -> DataFrame:
    frame = B.weekly_outcome(spark, base)
    return rounded(
        shape.trajectory_bands(
            frame, "week", ["arm"], "y", ["patient_id", "week"], REPLICATES, draw=digest_draw
        )
    )


@query(
    "AGG11_histogram",
    "SELECT CAST(floor(p_size / 10.0) * 10 AS BIGINT) AS bin_start, count(*) AS n FROM part GROUP BY 1",
)
def histogram(spark: SparkSession, base: str) -> DataFrame:
    return shape.histogram(T.load(spark, base, "part"), "p_size", 10)


@query(
    "AGG11_counts_by_category",
    with_frames("SELECT status, count(*) AS n FROM patients GROUP BY 1", "patients"),
)
def category_counts(spark: SparkSession, base: str) -> DataFrame:
    return shape.value_counts(B.patients(spark, base), ["status"])


@query(
    "AGG12_count_pivot",
    with_frames(
        """SELECT week, count(DISTINCT patient_id) FILTER (WHERE arm = 0) AS arm_0,
        count(DISTINCT patient_id) FILTER (WHERE arm = 1) AS arm_1 FROM weekly_outcome GROUP BY 1""",
        "weekly_outcome",
    ),
)
def count_pivot(spark: SparkSession, base: str) -> DataFrame:
    df = shape.count_pivot(B.weekly_outcome(spark, base), "week", "arm", "patient_id", [0, 1])
    return df.withColumnsRenamed({"0": "arm_0", "1": "arm_1"}).na.fill(0)


# Reshaping.


@query(
    "RSH1_pivot_first",
    with_frames(
        f"""SELECT patient_id, {', '.join(
            f"round(min_by({v}, reading_id) FILTER (WHERE seq = '{s}' AND {v} IS NOT NULL), 6) AS {s}_{v}"
            for v in ('bmi', 'weight') for s in ('baseline', 'latest'))}
        FROM (SELECT *, CASE WHEN ts <= enroll_ts THEN 'baseline' ELSE 'latest' END AS seq
            FROM scale JOIN anchors USING (patient_id)) GROUP BY 1""",
        "scale",
        "anchors",
    ),
)
def pivot_first(spark: SparkSession, base: str) -> DataFrame:
    df = B.scale(spark, base).join(B.anchors(spark, base), "patient_id")
    seq = F.when(F.col("ts") <= F.col("enroll_ts"), "baseline").otherwise("latest")
    labels = ["baseline", "latest"]
    return rounded(
        shape.pivot_first(df.withColumn("seq", seq), "patient_id", "seq", labels, ["bmi", "weight"], "reading_id")
    )


METRICS = ", ".join(cgm.WEEKLY_METRICS)


@query(
    "RSH2_melt",
    with_frames(
        f"""SELECT patient_id, week, variable,
        CASE WHEN variable IN ('std', 'cv') THEN round(value, 4) ELSE round(value, 7) END AS value
        FROM (UNPIVOT (SELECT patient_id, week, {METRICS} FROM weekly_all) ON {METRICS}
        INTO NAME variable VALUE value)""",
        "weekly_all",
    ),
)
def melt(spark: SparkSession, base: str) -> DataFrame:
    df = shape.melt(weekly(spark, base, None), ["patient_id", "week"], cgm.WEEKLY_METRICS)
    value = F.when(F.col("variable").isin("std", "cv"), F.round("value", 4)).otherwise(F.round("value", 7))
    return df.withColumn("value", value)


# Windows.


@query(
    "WIN1_seq_ranks",
    with_frames(
        """SELECT patient_id, week, CAST(dense_rank() OVER (PARTITION BY patient_id ORDER BY week) AS INTEGER)
        AS seq_asc, CAST(dense_rank() OVER (PARTITION BY patient_id ORDER BY week DESC) AS INTEGER) AS seq_desc
        FROM weekly""",
        "weekly",
    ),
)
def seq_ranks(spark: SparkSession, base: str) -> DataFrame:
    df = windows.seq_ranks(weekly(spark, base), ["patient_id"], "week")
    return df.select("patient_id", "week", "seq_asc", "seq_desc")


@query(
    "WIN1_seq_ranks_readings",
    with_frames(
        """SELECT patient_id, reading_id,
        CASE WHEN seen IS NOT NULL THEN dense_rank() OVER (PARTITION BY patient_id ORDER BY seen NULLS LAST) END
            AS seq_asc,
        CASE WHEN seen IS NOT NULL THEN dense_rank() OVER (PARTITION BY patient_id ORDER BY seen DESC NULLS LAST) END
            AS seq_desc
        FROM (SELECT *, CASE WHEN reading_id % 97 <> 0 THEN ts END AS seen FROM readings)""",
        "readings",
    ),
)
def seq_ranks_readings(spark: SparkSession, base: str) -> DataFrame:
    seen = F.when(F.col("reading_id") % 97 != 0, F.col("ts"))
    rows = B.readings(spark, base).withColumn("seen", seen)
    df = windows.seq_ranks(rows, ["patient_id"], "seen", time_chunk("seen"))
    return df.select("patient_id", "reading_id", "seq_asc", "seq_desc")


@query(
    "WIN2_keep_one",
    with_frames(
        f"""SELECT patient_id, reading_id, {ts_sql('ts')}, weight FROM (
        SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY d, ts, reading_id) AS k FROM (
        SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY patient_id, CAST(ts AS DATE)
            ORDER BY ts DESC, reading_id DESC) AS rn FROM scale) WHERE rn = 1) WHERE k = 1""",
        "scale",
    ),
)
def keep_one(spark: SparkSession, base: str) -> DataFrame:
    df = B.scale(spark, base).withColumn("d", F.to_date("ts"))
    daily = windows.keep_one(df, ["patient_id", "d"], ["ts", "reading_id"], "last")
    first = windows.keep_one(daily, ["patient_id"], ["d", "ts", "reading_id"], "first")
    return first.select("patient_id", "reading_id", ts_text("ts"), "weight")


@query(
    "WIN3_first_last_pair",
    with_frames("SELECT patient_id, week, seq, week_count, round(TIR, 6) AS TIR FROM pairs", "pairs"),
)
def first_last_pair(spark: SparkSession, base: str) -> DataFrame:
    df = windows.first_last_pair(weekly(spark, base), "patient_id", "week")
    return rounded(df.select("patient_id", "week", "seq", "week_count", "TIR"))


@query(
    "WIN3_first_last_lone",
    with_frames(
        """SELECT patient_id, reading_id, CASE WHEN ts = lo THEN 'first' ELSE 'last' END AS seq
        FROM (SELECT *, min(ts) OVER (PARTITION BY patient_id) AS lo,
            max(ts) OVER (PARTITION BY patient_id) AS hi FROM scale) WHERE ts = lo OR ts = hi""",
        "scale",
    ),
)
def first_last_lone(spark: SparkSession, base: str) -> DataFrame:
    df = windows.first_last_pair(B.scale(spark, base), "patient_id", "ts", lone=True, spread=True)
    return df.select("patient_id", "reading_id", "seq")


@query(
    "WIN4_argmin_row",
    with_frames(
        """SELECT patient_id, week, round(y, 6) AS y FROM (SELECT *,
        row_number() OVER (PARTITION BY patient_id ORDER BY y, week) AS rn FROM weekly_outcome) WHERE rn = 1""",
        "weekly_outcome",
    ),
)
def argmin_row(spark: SparkSession, base: str) -> DataFrame:
    df = windows.argmin_row(B.weekly_outcome(spark, base), "patient_id", "y", "week")
    return rounded(df.select("patient_id", "week", "y"))


@query(
    "WIN5_first_after_anchor",
    with_frames(
        f"""SELECT patient_id, strftime(coalesce(hit, last_ts), '%Y-%m-%d %H:%M:%S.%f') AS position,
        CASE WHEN last_ts IS NOT NULL THEN hit IS NOT NULL END AS found
        FROM (SELECT patient_id, min(CASE WHEN ts > enroll_ts AND glucose > 100 THEN ts END) AS hit,
            max(CASE WHEN ts > enroll_ts THEN ts END) AS last_ts
            FROM readings JOIN anchors USING (patient_id) GROUP BY 1)""",
        "readings",
        "anchors",
    ),
)
def first_after_anchor(spark: SparkSession, base: str) -> DataFrame:
    df = B.readings(spark, base).join(B.anchors(spark, base), "patient_id")
    out = windows.first_after_anchor(df, "patient_id", "ts", "enroll_ts", F.col("glucose") > 100)
    return out.select("patient_id", ts_text("position"), "found")


# Glucose metrics.


@query(
    "CGM1_daily_summary",
    with_frames(
        f"""SELECT patient_id, {day_sql('date')}, {day_sql('first_date')}, data_count, valid_data, vlow, low,
        high, vhigh, in_range_tight, {r('mean', 'std', 'lbgi', 'hbgi', digits=5)} FROM daily""",
        "daily",
    ),
)
def daily_summary(spark: SparkSession, base: str) -> DataFrame:
    df = B.daily(spark, base)
    filled = [F.col(c) for c in ("data_count", "valid_data", "vlow", "low", "high", "vhigh", "in_range_tight")]
    out = df.select("patient_id", day_text("date"), day_text("first_date"), *filled, "mean", "std", "lbgi", "hbgi")
    return rounded(out, 5)


METRICS_SQL = """SELECT m.patient_id, n, round(mean, 8) AS mean, round(sd, 6) AS sd, round(sd / mean, 6) AS cv,
        round((n - vlow - low - high - vhigh) / n, 6) AS TIR, round((vlow + low) / n, 6) AS TBR,
        round((high + vhigh) / n, 6) AS TAR,
        round((3.0 * vlow + 2.4 * low + 1.6 * vhigh + 0.8 * high) / n, 6) AS GRI,
        round(lbgi, 5) AS lbgi, round(hbgi, 5) AS hbgi,
        round(CASE WHEN n >= 2 THEN coalesce(path, 0) / nullif(hours, 0) END, 6) AS MAG, round(MAGE, 7) AS MAGE
        FROM moments m LEFT JOIN (SELECT r.patient_id, sum(amplitude) AS path,
            avg(amplitude) FILTER (WHERE amplitude > sd) AS MAGE FROM runs r
            JOIN moments USING (patient_id) GROUP BY 1) s USING (patient_id)"""
METRIC_FRAMES = {
    "moments": """SELECT patient_id, count(*) AS n, avg(glucose) AS mean, stddev_samp(glucose) AS sd,
        count(*) FILTER (WHERE glucose < 3) AS vlow,
        count(*) FILTER (WHERE glucose >= 3 AND glucose < 3.9) AS low,
        count(*) FILTER (WHERE glucose > 10 AND glucose <= 13.9) AS high,
        count(*) FILTER (WHERE glucose > 13.9) AS vhigh,
        avg(CASE WHEN f < 0 THEN 10 * f * f ELSE 0 END) AS lbgi,
        avg(CASE WHEN f > 0 THEN 10 * f * f ELSE 0 END) AS hbgi,
        epoch_us(max(ts)) / 3.6e9 - epoch_us(min(ts)) / 3.6e9 AS hours FROM risk GROUP BY 1""",
    "steps": """SELECT * FROM (SELECT patient_id, ts, reading_id,
        glucose - lag(glucose) OVER (PARTITION BY patient_id ORDER BY ts, reading_id) AS step FROM risk)
        WHERE step <> 0""",
    "turns": """SELECT *, CASE WHEN (step > 0) <> lag(step > 0) OVER
        (PARTITION BY patient_id ORDER BY ts, reading_id) THEN 1 ELSE 0 END AS turned FROM steps""",
    "runs": """SELECT patient_id, run, sum(abs(step)) AS amplitude FROM (SELECT *, sum(turned) OVER
        (PARTITION BY patient_id ORDER BY ts, reading_id) AS run FROM turns) GROUP BY 1, 2""",
}


@query("CGM2_patient_metrics", with_frames(METRICS_SQL, "risk", extra=METRIC_FRAMES))
def patient_metrics(spark: SparkSession, base: str) -> DataFrame:
    return rounded(cgm.patient_metrics(B.readings(spark, base)), {"mean": 8, "lbgi": 5, "hbgi": 5, "MAGE": 7})


COUNTS = "valid_data, vlow, low, high, vhigh, in_range_tight"
RATIOS = r("mean", "lbgi", "hbgi", "TIR", "TBR", "TBR_II", "TAR", "TAR_II", "GRI", "valid_rate")


@query(
    "CGM3_weekly_rollup",
    with_frames(
        f"""SELECT patient_id, week, {COUNTS}, {RATIOS}, round(std, 4) AS std, round(cv, 5) AS cv
        FROM weekly_all""",
        "weekly_all",
    ),
)
def weekly_rollup(spark: SparkSession, base: str) -> DataFrame:
    return rounded(weekly(spark, base, None), {"std": 4, "cv": 5})


@query(
    "CGM3_weekly_rollup_valid",
    with_frames(
        f"""SELECT patient_id, week, week_count, {COUNTS}, {RATIOS}, round(std, 5) AS std, round(cv, 6) AS cv
        FROM weekly""",
        "weekly",
    ),
)
def weekly_rollup_valid(spark: SparkSession, base: str) -> DataFrame:
    return rounded(weekly(spark, base), {"std": 5})


@query(
    "CGM4_valid_weeks",
    with_frames(
        f"""SELECT patient_id, {day_sql('date')}, week, valid_data, CAST(week_valid_sum AS BIGINT) AS week_valid_sum,
        week_count FROM days JOIN (SELECT *, count(*) OVER (PARTITION BY patient_id) AS week_count
            FROM (SELECT patient_id, week, sum(valid_data) AS week_valid_sum FROM days GROUP BY 1, 2)
            WHERE week_valid_sum >= 10) USING (patient_id, week)""",
        "days",
    ),
)
def valid_weeks(spark: SparkSession, base: str) -> DataFrame:
    df = cgm.valid_weeks(B.daily(spark, base), B.MIN_VALID)
    return df.select("patient_id", day_text("date"), "week", "valid_data", "week_valid_sum", "week_count")


WEAR = """SELECT patient_id, count(DISTINCT date) AS days, CAST(sum(valid_data) AS BIGINT) AS data_valid,
    sum(valid_data) / (count(DISTINCT date) * 3) AS rate FROM days GROUP BY 1"""


@query(
    "CGM5_wear_rate",
    with_frames(
        "SELECT patient_id, days, data_valid, round(rate, 6) AS data_valid_rate FROM wear",
        "days",
        extra={"wear": WEAR},
    ),
)
def wear_rate(spark: SparkSession, base: str) -> DataFrame:
    return rounded(cgm.wear_rate(B.daily(spark, base), per_day=B.PER_DAY))


@query(
    "CGM5_mean_wear_rate",
    with_frames("SELECT round(avg(rate), 6) AS mean_rate FROM wear", "days", extra={"wear": WEAR}),
)
def mean_wear_rate(spark: SparkSession, base: str) -> DataFrame:
    return rounded(cgm.mean_wear_rate(cgm.wear_rate(B.daily(spark, base), per_day=B.PER_DAY)))


def agp_sql(keys: str, minutes: int, frame: str) -> str:
    points = ", ".join(
        f"round(quantile_cont(glucose, {p}), 6) AS {n}" for n, p in cgm.AGP_PERCENTILES.items()
    )
    return f"""SELECT {keys}, CAST(floor((hour(ts) * 60 + minute(ts)) / {minutes}) AS INTEGER) AS bin,
        count(*) AS n, {points}, round(avg(CASE WHEN glucose BETWEEN 3.9 AND 10 THEN 1 ELSE 0 END), 6) AS in_range
        FROM {frame} WHERE glucose >= 1.1 GROUP BY ALL"""


@query("CGM6_agp_patient", with_frames(agp_sql("patient_id", 240, "readings"), "readings"))
def agp_patient(spark: SparkSession, base: str) -> DataFrame:
    return rounded(cgm.agp(B.readings(spark, base), ["patient_id"], bin_minutes=240))


@query(
    "CGM6_agp_group",
    with_frames(agp_sql("status", 15, "(readings JOIN patients USING (patient_id))"), "readings", "patients"),
)
def agp_group(spark: SparkSession, base: str) -> DataFrame:
    df = B.readings(spark, base).join(B.patients(spark, base), "patient_id")
    return rounded(cgm.agp(df, ["status"], bin_minutes=15))


# Quality rates and cohort rules.


def day_records(spark: SparkSession, base: str) -> DataFrame:
    maps = B.day_maps(spark, base)
    count = F.size("daily_data")
    return maps.select(
        F.concat(F.lit("D"), F.col("patient_id").cast("string")).alias("device_id"),
        "date",
        (count - count_below("daily_data")).cast("bigint").alias("valid_data"),
        count.cast("bigint").alias("data_count"),
        F.col("date").cast("timestamp").alias("updated_at"),
    )


DEVICES = """SELECT 'D' || patient_id AS device_id, date >= DATE '2024-01-20' AS updated_since,
    CAST(sum(valid) AS BIGINT) AS valid_data, CAST(sum(n) AS BIGINT) AS data_count, max(date) AS last_updated_at,
    count(*) AS days
    FROM (SELECT patient_id, date, count(*) AS n, count(*) FILTER (WHERE glucose >= 1.1) AS valid
        FROM day_long GROUP BY 1, 2)
    WHERE patient_id NOT IN (SELECT patient_id FROM readings WHERE glucose > 300) GROUP BY 1, 2"""


def devices(spark: SparkSession, base: str) -> DataFrame:
    listed = B.readings(spark, base).where("glucose > 300").select("device_id")
    return quality.device_quality(day_records(spark, base), "2024-01-20", listed)


@query(
    "QC1_device_quality",
    with_frames(
        f"""SELECT device_id, updated_since, valid_data, data_count, {day_sql('last_updated_at')}, days,
        round(1 - valid_data / data_count, 6) AS abnormal_rate FROM devices""",
        "day_long",
        extra={"devices": DEVICES},
    ),
)
def device_quality(spark: SparkSession, base: str) -> DataFrame:
    df = devices(spark, base).withColumn("last_updated_at", F.date_format("last_updated_at", "yyyy-MM-dd"))
    return rounded(df).orderBy("updated_since", F.desc("abnormal_rate"), "device_id")


@query(
    "QC1_overall_quality",
    with_frames(
        """SELECT updated_since, round(1 - sum(valid_data) / sum(data_count), 6) AS abnormal_rate
        FROM devices GROUP BY 1""",
        "day_long",
        extra={"devices": DEVICES},
    ),
)
def overall_quality(spark: SparkSession, base: str) -> DataFrame:
    return rounded(quality.overall_quality(devices(spark, base)))


@query(
    "QC2_consistent_exposure",
    with_frames(
        """SELECT oid, patient_id, exposed FROM orders_f WHERE patient_id IN (SELECT patient_id FROM orders_f
        GROUP BY 1 HAVING avg(CAST(exposed AS INTEGER)) IN (0, 1))""",
        "orders_f",
    ),
)
def consistent_exposure(spark: SparkSession, base: str) -> DataFrame:
    df = quality.consistent_exposure(B.orders_f(spark, base), "patient_id", "exposed")
    return df.select("oid", "patient_id", "exposed")


@query(
    "QC3_adequate_week",
    with_frames(
        """SELECT CAST(coalesce(min(week) FILTER (WHERE arms < 2) - 1, max(week)) AS INTEGER) AS cut_week
        FROM (SELECT week, count(*) FILTER (WHERE n >= 10) AS arms
        FROM (SELECT week, patient_id % 2 AS arm, count(DISTINCT patient_id) AS n FROM weekly GROUP BY 1, 2)
        GROUP BY 1)""",
        "weekly",
    ),
)
def adequate_week(spark: SparkSession, base: str) -> DataFrame:
    df = weekly(spark, base).withColumn("arm", F.col("patient_id") % 2)
    return quality.adequate_week(df, "week", "arm")


@query(
    "QC4_core_cohort",
    with_frames(
        """SELECT patient_id, week, round(y, 6) AS y FROM weekly_outcome JOIN anchors USING (patient_id)
        WHERE week <= 2 AND floor(floor(epoch(TIMESTAMP '2024-01-28' - enroll_ts) / 86400) / 7) >= 2
        AND patient_id IN (SELECT patient_id FROM weekly_outcome WHERE week <= 2 AND y > 0
            GROUP BY 1 HAVING count(DISTINCT week) >= 3)""",
        "weekly_outcome",
        "anchors",
    ),
)
def core_cohort(spark: SparkSession, base: str) -> DataFrame:
    df = B.weekly_outcome(spark, base).join(B.anchors(spark, base), "patient_id")
    core = quality.core_cohort(df, 2, "2024-01-28", start="enroll_ts", value="y")
    return rounded(core.select("patient_id", "week", "y"))


@query(
    "QC5_start_date",
    with_frames(
        """SELECT a.patient_id, o.paid_at IS NOT NULL AS is_paid, coalesce(o.exposed, false) AS exposed,
        CAST(CAST(coalesce(o.paid_at, a.enroll_ts) AS DATE) AS VARCHAR) AS start_date
        FROM anchors a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY paid_at, oid) AS rn
            FROM orders_f WHERE fee > 200000) o ON a.patient_id = o.patient_id AND rn = 1""",
        "anchors",
        "orders_f",
    ),
)
def start_date(spark: SparkSession, base: str) -> DataFrame:
    df = quality.start_date(B.anchors(spark, base), B.orders_f(spark, base).where("fee > 200000"))
    return df.select("patient_id", "is_paid", "exposed", day_text("start_date"))


# Revision audit.


def pairs(spark: SparkSession, base: str) -> DataFrame:
    return revision.snapshot_pair(B.snap_old(spark, base), B.snap_new(spark, base))


@query(
    "REV1_snapshot_delta",
    with_frames(
        """SELECT id, CAST(io AS INTEGER) AS invalid_old, CAST(inew AS INTEGER) AS invalid_new,
        CAST(inew - io AS INTEGER) AS invalid_delta, (inew - io) IS DISTINCT FROM 0 AS delta_changed
        FROM (SELECT id, count(*) FILTER (WHERE v < 1.1) AS io FROM old_long GROUP BY 1)
        LEFT JOIN (SELECT id, count(*) FILTER (WHERE v < 1.1) AS inew FROM new_long GROUP BY 1) USING (id)""",
        "old_long",
        "new_long",
    ),
)
def snapshot_delta(spark: SparkSession, base: str) -> DataFrame:
    df = revision.snapshot_delta(pairs(spark, base))
    return df.select("id", "invalid_old", "invalid_new", "invalid_delta", "delta_changed")


ENDS = "SELECT id, max(time) AS old_end, min(time) AS old_start FROM old_long GROUP BY 1"



def tenth_sql(v: str) -> str:
    """One decimal of a binary number: 10 v as a sum with its error, then half to even."""
    high, low = f"({v} * 8::DOUBLE)", f"({v} * 2::DOUBLE)"
    s = f"({high} + {low})"
    t = f"({s} - {high})"
    e = f"(({high} - ({s} - {t})) + ({low} - {t}))"
    f = f"(CASE WHEN {s} = floor({s}) AND {e} < 0 THEN floor({s}) - 1 ELSE floor({s}) END)"
    d = f"(2 * {s} - (2 * {f} + 1))"
    side = f"(CASE WHEN {d} <> 0 THEN {d} ELSE {e} END)"
    up = f"CASE WHEN {side} > 0 THEN 1 WHEN {side} < 0 THEN 0 WHEN {f} % 2 = 0 THEN 0 ELSE 1 END"
    return f"({f} + {up}) / 10::DOUBLE"


BOTH = f"""SELECT id, time, old_end, {tenth_sql("o.v")} AS a, {tenth_sql("n.v")} AS b,
    o.v IS NOT NULL AS in_old, n.v IS NOT NULL AS in_new
    FROM old_long o FULL JOIN new_long n USING (id, time) JOIN ends USING (id)
    WHERE id IN (SELECT id FROM new_long)"""


def diff_sql(strict: bool) -> str:
    keys = "added + missing + tail"
    count = f"CASE WHEN tail > 0 THEN {keys} ELSE 0 END" if strict else keys
    return f"""SELECT e.id, CASE WHEN d.id IS NOT NULL THEN e.old_end END AS old_end, new_end,
        coalesce(key_added, '') AS key_added, coalesce(key_missing, '') AS key_missing,
        coalesce(value_changed, '') AS value_changed, CAST(coalesce(tail, 0) AS INTEGER) AS key_delay,
        CAST(coalesce({count}, 0) AS INTEGER) AS key_changed_cnt, CAST(coalesce(moved, 0) AS INTEGER) AS value_changed_cnt,
        CASE WHEN d.id IS NULL THEN true ELSE added + missing + moved + tail > 0 END AS changed
        FROM ends e LEFT JOIN (SELECT id, added, missing, moved, key_added, key_missing, value_changed, new_end,
            CASE WHEN later > 3 THEN later ELSE 0 END AS tail FROM (SELECT id,
            max(time) FILTER (WHERE in_new) AS new_end,
            count(*) FILTER (WHERE NOT in_old AND time <= old_end) AS added,
            count(*) FILTER (WHERE NOT in_new) AS missing, count(*) FILTER (WHERE time > old_end) AS later,
            count(*) FILTER (WHERE in_old AND in_new AND a <> b) AS moved,
            string_agg(time, ',' ORDER BY time) FILTER (WHERE NOT in_old AND time <= old_end) AS key_added,
            string_agg(time, ',' ORDER BY time) FILTER (WHERE NOT in_new) AS key_missing,
            string_agg(time || '=' || printf('%.1f', a) || '>' || printf('%.1f', b), ',' ORDER BY time)
                FILTER (WHERE in_old AND in_new AND a <> b) AS value_changed
            FROM merged GROUP BY 1)) d USING (id)"""


def diff_text(df: DataFrame) -> DataFrame:
    moved = F.transform(
        "value_changed",
        lambda e: F.format_string("%s=%.1f>%.1f", e["time"], e["old_value"], e["new_value"]),
    )
    return df.select(
        "id",
        "old_end",
        "new_end",
        F.array_join("key_added", ",").alias("key_added"),
        F.array_join("key_missing", ",").alias("key_missing"),
        F.array_join(moved, ",").alias("value_changed"),
        "key_delay",
        "key_changed_cnt",
        "value_changed_cnt",
        "changed",
    )


SNAPS = {"ends": ENDS, "merged": BOTH}


@query("REV2_map_diff", with_frames(diff_sql(False), "old_long", "new_long", extra=SNAPS))
def map_diff(spark: SparkSession, base: str) -> DataFrame:
    return diff_text(revision.map_diff(pairs(spark, base)))


@query("REV2_map_diff_strict", with_frames(diff_sql(True), "old_long", "new_long", extra=SNAPS))
def map_diff_strict(spark: SparkSession, base: str) -> DataFrame:
    return diff_text(revision.map_diff(pairs(spark, base), strict_reference=True))


@query(
    "REV3_diff_totals",
    with_frames(
        f"""SELECT count(*) AS records, count(*) FILTER (WHERE changed) AS changed_rows,
        count(*) FILTER (WHERE key_changed_cnt > 0) AS key_rows,
        count(*) FILTER (WHERE value_changed_cnt > 0) AS value_rows FROM ({diff_sql(False)})""",
        "old_long",
        "new_long",
        extra=SNAPS,
    ),
)
def diff_totals(spark: SparkSession, base: str) -> DataFrame:
    return revision.diff_totals(revision.map_diff(pairs(spark, base)))


LONG = """SELECT id, time, a AS old_value, b AS new_value, CASE WHEN a IS NULL THEN 'only_new'
    WHEN b IS NULL THEN 'only_old' ELSE 'both' END AS key_status,
    a IS NOT NULL AND b IS NOT NULL AND coalesce(a <> b, false) AS value_changed,
    round(b - a, 6) AS value_delta FROM merged"""


@query(
    "REV4_map_diff_long",
    with_frames(f"{LONG} WHERE time <= old_end", "old_long", "new_long", extra=SNAPS),
)
def map_diff_long(spark: SparkSession, base: str) -> DataFrame:
    df = revision.map_diff_long(pairs(spark, base))
    return rounded(df.withColumn("value_changed", F.coalesce("value_changed", F.lit(False))))


@query(
    "REV4_changed_only",
    with_frames(
        f"SELECT * FROM ({LONG}) WHERE key_status <> 'both' OR value_changed", "old_long", "new_long", extra=SNAPS
    ),
)
def map_diff_changed(spark: SparkSession, base: str) -> DataFrame:
    df = revision.map_diff_long(pairs(spark, base), before_local_end=False, only_changed=True)
    return rounded(df.withColumn("value_changed", F.coalesce("value_changed", F.lit(False))))


@query(
    "REV5_snapshot_extent",
    with_frames(
        """SELECT id, least(old_start, new_start) AS first_time, greatest(old_end, new_end) AS last_time,
        old_end AS old_last_time FROM ends LEFT JOIN (SELECT id, max(time) AS new_end, min(time) AS new_start
            FROM new_long GROUP BY 1) USING (id)""",
        "old_long",
        "new_long",
        extra={"ends": ENDS},
    ),
)
def snapshot_extent(spark: SparkSession, base: str) -> DataFrame:
    df = revision.snapshot_extent(pairs(spark, base))
    return df.select("id", "first_time", "last_time", "old_last_time")


# Jobs on these operators.


NORMAL_TAIL = """CASE WHEN abs(z) > 8 THEN 0.0 ELSE 1 - 2 * (SELECT sum(w * exp(-0.5 * x * x)) FROM
    (SELECT (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS w,
        i * abs(z) / 2000 AS x FROM range(2001) t(i))) * abs(z) / 2000 / 3 / sqrt(2 * pi()) END"""

SIDES = """SELECT patient_id, variable, max(value) FILTER (WHERE seq = 'first') AS a,
    max(value) FILTER (WHERE seq = 'last') AS b FROM melted GROUP BY 1, 2"""
RANKED = """SELECT variable, a - b AS d, rank() OVER (PARTITION BY variable ORDER BY abs(a - b))
    + (count(*) OVER (PARTITION BY variable, abs(a - b)) - 1) / 2 AS rk,
    count(*) OVER (PARTITION BY variable, abs(a - b)) AS t FROM sides WHERE a <> b"""
SUMS = """SELECT variable, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS w_plus,
    coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS w_minus, sum(t * t - 1)::DOUBLE AS tie_term
    FROM ranked GROUP BY 1"""
TESTED = """SELECT s.variable, p.n_pairs, s.n, w_plus, w_minus, tie_term,
    (least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4)
    / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie_term / 48) AS z, p.median_a, p.median_b
    FROM sums s JOIN (SELECT variable, count(*) AS n_pairs, median(a) AS median_a, median(b) AS median_b
        FROM sides GROUP BY 1) p USING (variable)"""
WILCOXON = {"sides": SIDES, "ranked": RANKED, "sums": SUMS, "tested": TESTED}


@query(
    "STAT1_rank_sums",
    with_frames(
        """SELECT variable, n_pairs, n, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus,
        round(tie_term, 1) AS tie_term FROM tested""",
        "melted",
        extra=WILCOXON,
    ),
)
def rank_sums(spark: SparkSession, base: str) -> DataFrame:
    from cohortflow.operators.wilcoxon import pair_up, signed_ranks

    sides = pair_up(jobs.week_pairs(weekly(spark, base)), "patient_id", "variable")
    return rounded(signed_ranks(sides, "variable"), 1)


EFFECT_SQL = f"""SELECT variable, n_pairs, n, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus,
    round(z, 6) AS z, round({NORMAL_TAIL}, 6) AS p, round(median_a, 5) AS median_a,
    round(median_b, 5) AS median_b FROM tested"""


def effect(df: DataFrame) -> DataFrame:
    cols = ["variable", "n_pairs", "n", "w_plus", "w_minus", "z", "p", "median_a", "median_b"]
    digits = {"w_plus": 1, "w_minus": 1, "median_a": 5, "median_b": 5}
    return rounded(df.select(*cols), digits)


@query("STAT1_wilcoxon", with_frames(EFFECT_SQL, "melted", extra=WILCOXON))
def wilcoxon_test(spark: SparkSession, base: str) -> DataFrame:
    from cohortflow.operators.wilcoxon import pair_up, wilcoxon

    sides = pair_up(jobs.week_pairs(weekly(spark, base)), "patient_id", "variable")
    return effect(wilcoxon(sides, "variable", ))


@query(
    "JOB1_week_effect",
    with_frames(
        EFFECT_SQL,
        "weekly",
        extra={
            "pairs": B.SQL["pairs"].replace("FROM weekly)", "FROM weekly WHERE week_count >= 3)"),
            "melted": B.SQL["melted"],
            **WILCOXON,
        },
    ),
)
def week_effect(spark: SparkSession, base: str) -> DataFrame:
    df = jobs.week_effect(B.daily(spark, base), B.PER_DAY, B.MIN_VALID, min_weeks=3)
    return effect(df)


@query(
    "JOB1_week_effect_boxes",
    with_frames(box_sql("variable, seq", "melted", "value"), "melted"),
)
def week_effect_boxes(spark: SparkSession, base: str) -> DataFrame:
    return rounded(jobs.week_effect_boxes(B.daily(spark, base), B.PER_DAY, B.MIN_VALID))


TREND = f"""UNPIVOT (SELECT patient_id, week, {METRICS} FROM weekly WHERE week <= 12 AND week_count >= 2)
    ON {METRICS} INTO NAME variable VALUE value"""


@query(
    "JOB2_weekly_trend",
    with_frames(box_sql("variable, week", "trend", "value"), "weekly", extra={"trend": TREND}),
)
def weekly_trend(spark: SparkSession, base: str) -> DataFrame:
    return rounded(jobs.weekly_trend(weekly(spark, base), min_weeks=2))


@query(
    "JOB8_revision_audit",
    with_frames(
        f"""SELECT d.*, io AS invalid_old, inew AS invalid_new, (inew - io) IS DISTINCT FROM 0 AS delta_changed
        FROM ({diff_sql(False)}) d
        JOIN (SELECT id, CAST(count(*) FILTER (WHERE v < 1.1) AS INTEGER) AS io FROM old_long GROUP BY 1) USING (id)
        LEFT JOIN (SELECT id, CAST(count(*) FILTER (WHERE v < 1.1) AS INTEGER) AS inew FROM new_long GROUP BY 1)
            USING (id)""",
        "old_long",
        "new_long",
        extra=SNAPS,
    ),
)
def revision_audit(spark: SparkSession, base: str) -> DataFrame:
    def as_text(df: DataFrame) -> DataFrame:
        return df.withColumn("daily_data", F.to_json("daily_data"))

    df = jobs.revision_audit(as_text(B.snap_old(spark, base)), as_text(B.snap_new(spark, base)), text=True)
    counts = df.select("id", "invalid_old", "invalid_new", "delta_changed")
    return diff_text(df).join(counts, "id")
