"""Wilcoxon signed-rank test, one row per metric (STAT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.scalars import fmt_fixed
from cohortflow.operators.ordered import running_totals, value_band
from cohortflow.operators.quantiles import exact_quantiles
from cohortflow.operators.tails import normal_p, signed_rank_p
from cohortflow.session import keep


def pair_up(
    melted: DataFrame, key: str, by: str, seq: str = "seq", labels: tuple[str, str] = ("first", "last")
) -> DataFrame:
    """(patient, metric) rows with the first and the last value side by side.

    The two values meet in an aggregate on patient and metric, not by position.
    """

    def side(label: str) -> Column:
        return F.max(F.when(F.col(seq) == label, F.col("value")))

    return (
        melted.groupBy(key, by)
        .agg(side(labels[0]).alias("a"), side(labels[1]).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def signed_ranks(pairs: DataFrame, by: str, a: str = "a", b: str = "b") -> DataFrame:
    """Rank sums per metric.

    Equal absolute differences are counted and the counts written, zeros too;
    ranks then come from running counts over value bands, so no task holds all
    pairs of a metric.
    """
    d = F.col(a) - F.col(b)
    counts = keep(
        pairs.where(d.isNotNull())
        .groupBy(by, F.abs(d).alias("size"))
        .agg(
            F.count(F.lit(1)).alias("ties"),
            F.sum((d > 0).cast("bigint")).alias("ups"),
        ),
        "ties",
    )
    ranked = running_totals(counts.where("size > 0"), [by], "size", {"upto": "ties"}, value_band("size"))
    rank = F.col("upto") - (F.col("ties") - 1) / 2
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(by).agg(
        F.sum("ties").alias("n"),
        F.sum(rank * F.col("ups")).alias("w_plus"),
        F.sum(rank * (F.col("ties") - F.col("ups"))).alias("w_minus"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    totals = counts.groupBy(by).agg(F.sum("ties").alias("n_pairs"))
    zero = {"n": 0, "w_plus": 0.0, "w_minus": 0.0, "tie_term": 0.0}
    return totals.join(sums, by, "left").na.fill(zero)


def wilcoxon(
    pairs: DataFrame, by: str, a: str = "a", b: str = "b", method: str = "normal"
) -> DataFrame:
    """Paired test per metric: rank sums, z, p and its text, medians of both sides.

    Zero differences are dropped and ties share the average rank.  p is normal
    with the tie correction, at any size.  ``method="exact"`` takes the exact
    distribution instead for a metric without ties and zeros (``exact`` tells
    which); its work grows with the cube of the pairs.  p is 1 where every
    difference is zero.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"unknown method {method}")
    pairs = keep(pairs.select(by, a, b), "pairs")
    sums = signed_ranks(pairs, by, a, b)
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    w = F.least("w_plus", "w_minus")
    exact = F.lit(method == "exact") & (F.col("tie_term") == 0) & (F.col("n") == F.col("n_pairs"))
    tested = (
        sums.withColumn("w", w)
        .withColumn("z", F.try_divide(w - mean, F.sqrt(F.greatest(variance, F.lit(0.0)))))
        .withColumn("exact", exact)
    )
    # The frame has one row per metric; metrics tested otherwise pass 0 pairs.
    asked = F.when(F.col("exact"), F.col("n")).otherwise(F.lit(0))
    own = signed_rank_p(asked, F.col("w")) if method == "exact" else F.lit(None).cast("double")
    tested = (
        tested.withColumn("_normal", normal_p(F.col("z")))
        .withColumn("_exact", own)
        .withColumn(
            "p",
            F.when(F.col("n") == 0, 1.0)
            .when(F.col("exact"), F.col("_exact"))
            .otherwise(F.col("_normal")),
        )
        .withColumn(
            "p_text",
            F.when(F.col("p") < 0.001, "p < 0.001").otherwise(
                F.concat(F.lit("p = "), fmt_fixed("p", 3))
            ),
        )
        .drop("_normal", "_exact")
    )
    sides = pairs.select(by, F.col(a).alias("median_a"), F.col(b).alias("median_b"))
    middles = exact_quantiles(
        sides.unpivot(by, ["median_a", "median_b"], "side", "value"), [by, "side"], "value", {"median": 0.5}
    )
    wide = middles.groupBy(by).pivot("side", ["median_a", "median_b"]).agg(F.max("median"))
    return tested.join(wide, by, "left")
