"""User-level jobs (PIPE1 to PIPE9 of the survey), built from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.columns import bin_label, complete_cases, flag_contains, label_when
from cohortflow.functions.scalars import bmi_class, floor_div, parse_day_map, week_index
from cohortflow.operators import clusters, mixed, quality, revision, survival
from cohortflow.operators.cgm import PER_DAY, WEEKLY_METRICS, first_days, patient_metrics, weekly_rollup
from cohortflow.operators.joins import (
    anchored_window,
    attach,
    flag_member,
    union_aligned,
    with_offset,
)
from cohortflow.operators.shape import box_stats, first_by, melt, median_count, pivot_first
from cohortflow.operators.wilcoxon import pair_up, wilcoxon
from cohortflow.operators.windows import first_last_pair, keep_one
from cohortflow.session import cut_lineage


def week_pairs(weekly: DataFrame, min_weeks: int = 2) -> DataFrame:
    """First and last valid week per patient, one row per metric."""
    ends = first_last_pair(weekly.where(F.col("week_count") >= min_weeks), "patient_id", "week")
    return melt(
        ends.withColumn("care_period", bin_label("week_count")),
        ["patient_id", "seq", "week", "week_count", "care_period"],
        WEEKLY_METRICS,
    )


def week_effect(
    daily: DataFrame,
    per_day: int = PER_DAY,
    min_valid: int = PER_DAY * 5,
    min_weeks: int = 2,
    method: str = "normal",
) -> DataFrame:
    """First against last valid week: paired test and medians per metric (PIPE1)."""
    weekly = weekly_rollup(daily, per_day=per_day, min_valid=min_valid)
    pairs = pair_up(week_pairs(weekly, min_weeks), "patient_id", "variable")
    return wilcoxon(pairs, "variable", method=method)


def week_effect_boxes(
    daily: DataFrame,
    per_day: int = PER_DAY,
    min_valid: int = PER_DAY * 5,
    min_weeks: int = 2,
) -> DataFrame:
    """Box summaries of both ends per metric, the data of the comparison figure."""
    weekly = weekly_rollup(daily, per_day=per_day, min_valid=min_valid)
    return box_stats(cut_lineage(week_pairs(weekly, min_weeks)), ["variable", "seq"], "value")


def weekly_trend(weekly: DataFrame, min_weeks: int = 1, last_week: int = 12) -> DataFrame:
    """Median, count and box per metric and week (PIPE2)."""
    chosen = weekly.where((F.col("week") <= last_week) & (F.col("week_count") >= min_weeks))
    long = melt(chosen, ["patient_id", "week"], WEEKLY_METRICS)
    return box_stats(cut_lineage(long), ["variable", "week"], "value")


def trend_medians(weekly: DataFrame, min_weeks: int = 1, last_week: int = 12) -> DataFrame:
    chosen = weekly.where((F.col("week") <= last_week) & (F.col("week_count") >= min_weeks))
    return median_count(melt(chosen, ["patient_id", "week"], WEEKLY_METRICS), ["variable", "week"], "value")


def early_phenotype(
    readings: DataFrame,
    anchors: DataFrame,
    model: PipelineModel | clusters.Centres | None = None,
    features: Sequence[str] = clusters.FEATURES,
    k: int = 3,
    seed: int = 42,
) -> tuple[DataFrame, PipelineModel | clusters.Centres]:
    """Cluster patients by the metrics of their first seven days (PIPE3).

    A saved model may be one of stages or plain centres; without one it is fitted; patients with incomplete metrics keep
    their row with a NULL cluster.
    """
    early = first_days(readings, anchors).select("patient_id", "ts", "reading_id", "glucose")
    metrics = cut_lineage(patient_metrics(early))
    if model is None:
        model = clusters.fit_clusters(metrics, features, k, seed)
    if isinstance(model, clusters.Centres):
        labels = model.assign(metrics).select("patient_id", "cluster")
        return attach(anchors, labels, "patient_id"), model
    return clusters.assign_clusters(model, metrics, anchors), model


def baseline_latest(
    measures: DataFrame,
    anchors: DataFrame,
    days: int = 30,
    latest: str = "last",
    key: str = "patient_id",
    value: str = "bmi",
    anchor: str = "enroll_ts",
    tie: str = "reading_id",
) -> DataFrame:
    """Record up to ``days`` after the anchor against one after it (PIPE4).

    The last record of a day stands for the day.  The baseline is the first day
    with a known value; ``latest='last'`` takes the newest later such day,
    ``'first'`` the earliest one.  Columns are label_value.
    """
    if latest not in ("first", "last"):
        raise ValueError(f"unknown latest {latest}")
    since = with_offset(measures, anchors, key, "ts", anchor).where(F.col("ts") >= F.col(anchor))
    daily = keep_one(since.withColumn("_day", F.to_date("ts")), [key, "_day"], ["ts", tie], "last")
    seq = label_when(daily, "seq", [(F.col("days") <= days, "baseline")], "latest")
    day = F.unix_date("_day")
    order = F.when(F.col("seq") == "baseline", day).otherwise(-day if latest == "last" else day)
    both = seq.withColumn("grade", bmi_class(value)).withColumn("_order", order)
    return pivot_first(both, key, "seq", ["baseline", "latest"], [value, "grade"], "_order")


def first_last_measure(
    measures: DataFrame, key: str = "patient_id", value: str = "bmi", tie: str = "reading_id"
) -> DataFrame:
    """First and last record of one or of merged sources, side by side.

    A patient with one record has a first and no last one.  Records are ranked
    whether their value is known or not, so an unknown first value stays unknown.
    """
    ends = first_last_pair(measures, key, "ts", lone=True, spread=True)
    graded = ends.withColumn("grade", bmi_class(value))
    return pivot_first(graded, key, "seq", ["first", "last"], [value, "grade"], tie)


def weekly_means(
    measures: DataFrame,
    starts: DataFrame,
    value: str = "bmi",
    key: str = "patient_id",
    start: str = "start_date",
    keep: Sequence[str] = (),
    paid: str | None = None,
) -> DataFrame:
    """Mean per patient and week since the start date; nothing before it.

    ``paid`` names the time of purchase in ``starts``; earlier measures of the
    start day don't count either.
    """
    since = with_offset(measures, starts, key, "ts", start).where("days >= 0")
    if paid:
        since = since.where(F.col("ts") >= F.col(paid))
    return (
        since.withColumn("week", week_index("days"))
        .groupBy(key, start, "week", *keep)
        .agg(F.avg(value).alias(value))
    )


@dataclass
class WeightModel:
    """Frames and fits of the outcome model."""

    frame: DataFrame
    cut_week: int
    fits: list[mixed.MixedFit]


def weight_frame(
    measures: DataFrame,
    starts: DataFrame,
    exams: DataFrame,
    prescriptions: DataFrame,
    token: str,
    value: str = "bmi",
    arm: str = "arm",
    key: str = "patient_id",
    window: int = 30,
    except_: Sequence[str] = (),
    paid: str = "paid_at",
    kept: bool = False,
) -> DataFrame:
    """Weekly outcome with baseline and drug flag, the input of the models (PIPE5).

    ``starts`` has the start date and the time of purchase, from which measures
    and exams count.  The baseline is the week-0 mean, else the last exam of the
    first day with one in the seven days after the purchase.  The flag tells a
    listed drug within 30 days around the start.  ``kept`` says that the frames
    are stored already; where they are stored by buckets of the patient, nothing
    is shuffled.
    """
    if not kept:
        starts = cut_lineage(starts)
    weekly = weekly_means(measures, starts, value, key, keep=[arm], paid=paid)
    if not kept:
        weekly = cut_lineage(weekly)
    base = first_by(weekly.where("week = 0"), key, "week", value).withColumnRenamed(value, "base_bmi")
    early = anchored_window(exams, starts.select(key, paid), key, "ts", paid, 0, 6)
    daily = keep_one(early.withColumn("_day", F.to_date("ts")), [key, "_day"], ["ts", "reading_id"], "last")
    extra = keep_one(daily, [key], ["_day"]).select(key, F.col(value).alias("_extra"))
    around = anchored_window(
        prescriptions, starts.select(key, "start_date"), key, "date", "start_date", -window, window
    )
    users = around.where(flag_contains("medicine", token, except_))
    with_base = attach(attach(weekly, base, key), extra, key)
    with_base = with_base.withColumn("base_bmi", F.coalesce("base_bmi", "_extra")).drop("_extra")
    return flag_member(with_base, users, key, "drug")


def weight_model(
    frame: DataFrame,
    terms: Sequence[str],
    value: str = "bmi",
    arm: str = "arm",
    key: str = "patient_id",
    min_n: int = 10,
    reml: bool = False,
) -> WeightModel:
    """Cut the follow-up where an arm gets too small and fit the model (PIPE5)."""
    frame = cut_lineage(frame)
    cut = quality.adequate_week(frame, "week", arm, min_n, key).first()["cut_week"]
    chosen = complete_cases(frame.where(F.col("week") <= cut), ["base_bmi", arm, "drug"])
    return WeightModel(chosen, cut, mixed.fit_mixed(chosen, value, terms, key, reml))


@dataclass
class ReboundReport:
    """Events, survival curves, log-rank test and, with covariates, hazard ratios."""

    events: DataFrame
    curves: DataFrame
    test: DataFrame
    hazards: DataFrame | None


def rebound_report(
    weekly: DataFrame,
    ratio: float = 0.05,
    arm: str = "arm",
    arm_value: object = 1,
    covariates: Sequence[str] = ("arm", "drug", "base"),
    value: str = "bmi",
    base: str = "base_bmi",
) -> ReboundReport:
    """Time to regained weight by arm (PIPE6).  The events are written once."""
    own = [c for c in dict.fromkeys([arm, *covariates]) if c != "base"]
    events = cut_lineage(survival.rebound_events(weekly, ratio, value=value, base=base, covariates=own))
    followed = events.where(F.col("T") > 0)
    return ReboundReport(
        events,
        survival.kaplan_meier(followed, by=[arm]),
        survival.logrank(followed, arm_value, arm=arm),
        survival.cox_ph(followed, x=list(covariates)) if covariates else None,
    )


def wide_table(
    base: DataFrame,
    sources: Mapping[str, tuple[DataFrame, Sequence[str], str]],
    anchor: str,
    window_days: int = 93,
    horizon: int = 93 * 4 + 1,
    key: str = "patient_id",
    codes: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per patient, one column per measure and window since the base date (PIPE7).

    ``sources`` gives per name the frame (key, ts, ...), its measures and the
    aggregate, ``last`` or ``mean``.  All sources become one long frame, so the
    table costs one shuffle per step whatever the number of measures.  ``codes``
    names a source in long form (code, result) and its codes.
    """
    names: list[tuple[str, str]] = []
    long: list[DataFrame] = []
    for name, (frame, measures, how) in sources.items():
        if how not in ("last", "mean"):
            raise ValueError(f"unknown aggregate {how}")
        if codes and codes[0] == name:
            listed = list(codes[1])
            part = frame.where(F.col("code").isin(listed)).select(
                key, "ts", F.concat(F.lit(f"{name}_"), "code").alias("measure"), F.col(measures[0]).alias("value")
            )
            names += [(f"{name}_{c}", how) for c in listed]
        else:
            part = melt(frame, [key, "ts"], measures).select(
                key, "ts", F.concat(F.lit(f"{name}_"), "variable").alias("measure"), "value"
            )
            names += [(f"{name}_{m}", how) for m in measures]
        long.append(part)
    rows = union_aligned(long).where(F.col("value").isNotNull())
    since = anchored_window(rows, base.select(key, anchor), key, "ts", anchor, 0, horizon - 1)
    windows = range(-(-horizon // window_days))
    cells = since.withColumn("w", floor_div(F.col("days"), window_days).cast("int")).groupBy(
        key, "measure", "w"
    ).agg(F.max_by("value", F.struct("ts", "value")).alias("last"), F.avg("value").alias("mean"))

    def cell(measure: str, how: str, w: int) -> Column:
        here = (F.col("measure") == measure) & (F.col("w") == w)
        return F.max(F.when(here, F.col(how))).alias(f"{measure}_w{w + 1}")

    wide = cells.groupBy(key).agg(*[cell(m, how, w) for m, how in names for w in windows])
    return attach(base, wide, key)


def revision_audit(
    old: DataFrame, new: DataFrame, key: str = "id", strict_reference: bool = False, text: bool = False
) -> DataFrame:
    """Every old record with its count delta and map diff (PIPE8).

    Pass the frames with maps, or with map text and ``text``.
    """
    if text:
        old = old.withColumn("daily_data", parse_day_map("daily_data"))
        new = new.withColumn("daily_data", parse_day_map("daily_data"))
    pairs = revision.snapshot_delta(revision.snapshot_pair(old, new, key))
    return revision.map_diff(pairs, strict_reference=strict_reference)


def prescription_timeline(
    prescriptions: DataFrame,
    starts: DataFrame,
    token: str,
    except_: Sequence[str] = (),
    lo: int | None = None,
    hi: int | None = None,
    key: str = "patient_id",
    *,
    order: Sequence[str],
) -> DataFrame:
    """Newest prescription of a drug class per patient, days from the start, and
    the number of different medicines (PIPE9).  End ``order`` with a unique column."""
    timed = anchored_window(
        prescriptions.where(flag_contains("medicine", token, except_)),
        starts,
        key,
        "date",
        "start_date",
        lo,
        hi,
        "pres_days",
    )
    kinds = timed.groupBy(key).agg(F.countDistinct("medicine").alias("n_medicines"))
    return keep_one(timed, [key], order, "last").join(kinds, key)
