"""Quality rates and cohort rules (QC1 to QC5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalars import elapsed_days, week_index
from cohortflow.operators.joins import anti, attach, semi
from cohortflow.operators.windows import keep_one


def device_quality(
    records: DataFrame, as_of: object, exclude: DataFrame | None = None, key: str = "device_id"
) -> DataFrame:
    """Abnormal rate per device, apart for records updated since the as-of date.

    ``exclude`` lists test devices.  Sort by ``abnormal_rate`` to rank them.
    """
    if exclude is not None:
        records = anti(records, exclude, key)
    fresh = F.col("updated_at") >= F.lit(as_of).cast("timestamp")
    return (
        records.withColumn("updated_since", fresh)
        .where(F.col(key).isNotNull() & F.col("updated_since").isNotNull())
        .groupBy(key, "updated_since")
        .agg(
            F.coalesce(F.sum("valid_data"), F.lit(0)).alias("valid_data"),
            F.coalesce(F.sum("data_count"), F.lit(0)).alias("data_count"),
            F.max("updated_at").alias("last_updated_at"),
            F.count("date").alias("days"),
        )
        .withColumn("abnormal_rate", 1 - F.try_divide("valid_data", "data_count"))
    )


def overall_quality(devices: DataFrame) -> DataFrame:
    """One rate for fresh and one for older records."""
    rate = 1 - F.try_divide(F.sum("valid_data"), F.sum("data_count"))
    return devices.groupBy("updated_since").agg(rate.alias("abnormal_rate"))


def exposure_share(orders: DataFrame, key: str, flag: str) -> DataFrame:
    return orders.groupBy(key).agg(F.avg(F.col(flag).cast("int")).alias("share"))


def consistent_exposure(orders: DataFrame, key: str, flag: str) -> DataFrame:
    """Orders of users whose known flags are all true or all false."""
    share = exposure_share(orders, key, flag)
    mixed = share.where(F.col("share").isNull() | ((F.col("share") > 0) & (F.col("share") < 1)))
    return anti(orders, mixed.select(key), key)


def adequate_week(
    df: DataFrame, week: str, arm: str, min_n: int = 10, key: str = "patient_id"
) -> DataFrame:
    """Last week before the first one in which fewer than two arms reach ``min_n``.

    A week lacking an arm fails; with no failing week the last week is returned.
    """
    known = df.where(F.col(week).isNotNull() & F.col(arm).isNotNull())
    per_arm = known.groupBy(week, arm).agg(F.countDistinct(key).alias("n"))
    ok = F.sum((F.col("n") >= min_n).cast("int"))
    weeks = per_arm.groupBy(week).agg((ok >= 2).alias("enough"))
    cut = F.coalesce(F.min(F.when(~F.col("enough"), F.col(week))) - 1, F.max(week))
    return weeks.agg(cut.alias("cut_week"))


def core_cohort(
    df: DataFrame,
    weeks: int,
    as_of: object,
    start: str = "start_date",
    week: str = "week",
    value: str = "bmi",
    key: str = "patient_id",
) -> DataFrame:
    """Rows up to week W of patients followed that long and measured every week."""
    until = F.lit(as_of).cast("timestamp")
    followed = week_index(elapsed_days(start, until)) >= weeks
    upto = df.where(followed & (F.col(week) <= weeks))
    full = (
        upto.where(F.col(value) > 0)
        .groupBy(key)
        .agg(F.countDistinct(week).alias("_weeks"))
        .where(F.col("_weeks") >= weeks + 1)
    )
    return semi(upto, full.select(key), key)


def start_date(
    patients: DataFrame,
    orders: DataFrame,
    key: str = "patient_id",
    enrolled: str = "enroll_ts",
    paid: str = "paid_at",
    flag: str = "exposed",
    tie: str = "oid",
) -> DataFrame:
    """Day of the earliest qualifying order, else of enrolment.

    One first order per patient is taken (ties by order id), so a patient is not
    repeated; its flag comes along, false when there is no order.
    """
    known = orders.where(F.col(paid).isNotNull())
    first = keep_one(known, [key], [paid, tie]).select(key, paid, flag)
    return (
        attach(patients, first, key)
        .withColumn("is_paid", F.col(paid).isNotNull())
        .withColumn("start_date", F.to_date(F.coalesce(F.col(paid), F.col(enrolled))))
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    )
