"""Time-to-event analysis (SURV1 to SURV4)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.ordered import running_totals
from cohortflow.operators.shape import Z95
from cohortflow.operators.tails import chi2_one_p, chi2_tail, normal_two_sided
from cohortflow.session import cut_lineage

# Distinct times of a piece, up to PIECE squared of them; beyond that the number of pieces and
# their size grow alike, with the square root.
PIECE = 4096


def in_pieces(df: DataFrame, t: str) -> DataFrame:
    """Add ``_piece``, which cuts the distinct times into nearly equal pieces in order.

    The cuts are approximate quantiles of the distinct times, so the unit of time
    doesn't matter.  ``df`` is read twice here and should be written before.
    """
    times = df.where(F.col(t).isNotNull()).select(F.col(t).cast("double").alias("_t")).distinct()
    count = times.count()
    pieces = max(1, min(-(-count // PIECE), math.isqrt(count)))
    probs = [i / pieces for i in range(1, pieces)]
    cuts = sorted(set(times.approxQuantile("_t", probs, 0.2 / pieces))) if probs else []
    if not cuts:
        return df.withColumn("_piece", F.lit(0).cast("bigint"))
    splits = [-math.inf, *cuts, math.inf]
    place = Bucketizer(splits=splits, inputCol="_t", outputCol="_bucket", handleInvalid="keep")
    placed = place.transform(df.withColumn("_t", F.col(t).cast("double")))
    return placed.withColumn("_piece", F.col("_bucket").cast("bigint")).drop("_t", "_bucket")


def rebound_events(
    weekly: DataFrame,
    ratio: float = 0.05,
    key: str = "patient_id",
    week: str = "week",
    value: str = "bmi",
    base: str = "base_bmi",
    covariates: Sequence[str] = (),
) -> DataFrame:
    """Weeks from the lowest value to the first later week that regained the given
    share of the loss; censored at the last week without one.

    The frame has one row per patient and week, so a patient's rows are bounded
    by the weeks of follow-up.  T is 0 where nothing follows the lowest week.
    """
    w = Window.partitionBy(key)
    known = df_known(weekly, [key, week, value, base, *covariates])
    low = F.min(F.struct(F.col(value).alias("v"), F.col(week).alias("w"))).over(w)
    marked = known.withColumn("_low", low).withColumn("_base", F.min(base).over(w))
    lo, at = F.col("_low.v"), F.col("_low.w")
    later = F.col(week) > at
    back = later & (F.col(value) >= lo + (F.col("_base") - lo) * ratio)
    first = F.min(F.when(back, F.col(week)))
    return marked.groupBy(key).agg(
        (F.coalesce(first, F.max(F.when(later, F.col(week))), F.max("_low.w")) - F.max("_low.w"))
        .cast("double")
        .alias("T"),
        first.isNotNull().cast("int").alias("E"),
        F.min("_base").alias("base"),
        *[F.min_by(c, week).alias(c) for c in covariates],
    )


def df_known(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def _life_table(df: DataFrame, t: str, e: str, by: Sequence[str]) -> DataFrame:
    """Events and patients at risk per distinct time, with the time's piece; ties collapse before any ordering."""
    counts = (
        df_known(df, [t, e, *by])
        .groupBy(*by, t)
        .agg(F.count(F.lit(1)).alias("leaving"), F.sum(F.col(e).cast("bigint")).alias("events"))
    )
    placed = in_pieces(cut_lineage(counts), t)
    return running_totals(placed, by, t, {"at_risk": "leaving"}, F.col("_piece"), descending=True)


def kaplan_meier(
    df: DataFrame, t: str = "T", e: str = "E", by: Sequence[str] = ("arm",)
) -> DataFrame:
    """Survival per arm and distinct time, with a log-log 95 % interval."""
    d, n = F.col("events").cast("double"), F.col("at_risk").cast("double")
    alive = F.col("events") < F.col("at_risk")
    steps = (
        _life_table(df, t, e, by)
        .withColumn("_log", F.when(alive, F.log1p(-d / n)).otherwise(0.0))
        .withColumn("_green", F.when(alive, d / (n * (n - d))).otherwise(0.0))
        .withColumn("_end", (~alive).cast("bigint"))
    )
    totals = {"_log_s": "_log", "_var": "_green", "_gone": "_end"}
    curve = running_totals(steps, by, t, totals, F.col("_piece"))
    s = F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_log_s"))
    inside = (F.col("_gone") == 0) & (F.col("_log_s") < 0)
    width = F.try_divide(Z95 * F.sqrt("_var"), F.col("_log_s"))
    # At 1 and at 0 the interval has no width.
    lo = F.when(inside, F.exp(F.col("_log_s") * F.exp(-width))).otherwise(s)
    hi = F.when(inside, F.exp(F.col("_log_s") * F.exp(width))).otherwise(s)
    return curve.select(
        *by,
        t,
        "at_risk",
        "events",
        (F.col("leaving") - F.col("events")).alias("censored"),
        s.alias("survival"),
        lo.alias("ci_lo"),
        hi.alias("ci_hi"),
    )


def logrank(
    df: DataFrame, arm_value: object, t: str = "T", e: str = "E", arm: str = "arm"
) -> DataFrame:
    """Two-group log-rank test of one arm against the others, one row.

    NULL statistics where an arm is empty or nothing happens.
    """
    mine = F.col(arm) == F.lit(arm_value)
    one = F.when(mine, 1).otherwise(0).cast("bigint")
    event = F.col(e).cast("bigint")
    counts = (
        df_known(df, [t, e, arm])
        .groupBy(t)
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.sum(one).alias("c1"),
            F.sum(event).alias("d"),
            F.sum(event * one).alias("d1"),
        )
    )
    placed = in_pieces(cut_lineage(counts), t)
    risk = running_totals(placed, [], t, {"n": "c", "n1": "c1"}, F.col("_piece"), descending=True)
    n, n1, d = (F.col(c).cast("double") for c in ("n", "n1", "d"))
    expected = d * n1 / n
    variance = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    one_row = risk.where("d > 0").agg(
        F.sum("d1").cast("double").alias("observed"),
        F.sum(expected).alias("expected"),
        F.sum(variance).alias("variance"),
    )
    gap = F.col("observed") - F.col("expected")
    v = F.when(F.col("variance") > 0, F.col("variance"))
    return one_row.withColumn("chi2", gap * gap / v).withColumn("p", chi2_one_p(F.col("chi2")))


# Terms of the Efron sums that are added one by one before the series takes over.
EXPLICIT = 16


def _tie_sums(z: Column, d: Column) -> tuple[Column, Column, Column]:
    """Sums of ln w, 1/w and 1/w^2 for w = z, z+1, ..., z+d-1.

    The first sixteen terms are added up; the rest, however many ties there are,
    come from the Stirling series, whose error is under 1e-12 from there on.
    """
    few = F.transform(
        F.sequence(F.lit(0), F.least(d, F.lit(EXPLICIT)).cast("int") - 1), lambda m: z + m
    )

    def add(f) -> Column:
        return F.aggregate(few, F.lit(0.0), lambda acc, w: acc + f(w))

    a, b = z + EXPLICIT, z + d
    h = b - a

    def psi(x: Column) -> Column:
        return -1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)

    def psi1(x: Column) -> Column:
        return 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)

    def gam(x: Column) -> Column:
        return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)

    grown = F.log1p(h / a)
    log_rest = h * F.ln(a) + (b - 0.5) * grown - h + gam(b) - gam(a)
    inv_rest = grown + psi(b) - psi(a)
    sq_rest = psi1(a) - psi1(b)

    def with_rest(part: Column, rest: Column) -> Column:
        return part + F.when(d > EXPLICIT, rest).otherwise(0.0)

    return (
        with_rest(add(lambda w: F.ln(w)), log_rest),
        with_rest(add(lambda w: 1 / w), inv_rest),
        with_rest(add(lambda w: 1 / (w * w)), sq_rest),
    )


def _cox_step(
    rows: DataFrame, beta: np.ndarray, ties: str
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information at beta: one job, one result row.

    The risk sums are made piece by piece of the distinct times.
    """
    p = len(beta)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    x = [F.col(f"x{i}") for i in range(p)]
    eta = sum((x[i] * float(beta[i]) for i in range(p)), F.lit(0.0))
    r, m = F.col("r"), F.col("m")
    sums = {"r": r}
    sums |= {f"r{i}": r * x[i] for i in range(p)}
    sums |= {f"r{i}_{j}": r * x[i] * x[j] for i, j in cells}
    event = F.col("e") == 1
    dead = {f"d{k[1:]}": F.when(event, c).otherwise(0.0) for k, c in sums.items()}
    per_time = (
        rows.withColumn("eta", eta)
        .withColumn("r", m * F.exp("eta"))
        .groupBy("t", "_piece")
        .agg(
            *[F.sum(c).alias(f"_{k}") for k, c in sums.items()],
            *[F.sum(c).alias(f"_{k}") for k, c in dead.items()],
            F.sum(F.when(event, m).otherwise(0)).cast("double").alias("deaths"),
            F.sum(F.when(event, m * F.col("eta")).otherwise(0.0)).alias("eta_dead"),
            *[F.sum(F.when(event, m * x[i]).otherwise(0.0)).alias(f"s{i}") for i in range(p)],
        )
    )
    risk = running_totals(
        per_time, [], "t", {k: f"_{k}" for k in sums}, F.col("_piece"), descending=True
    ).where("deaths > 0")
    n = F.col("deaths")
    total = F.col("r")
    if ties == "efron":
        mass = F.col("_d")
        z = F.greatest(total * n / mass - n + 1, F.lit(1.0))
        logs, inv, sq = _tie_sums(z, n)
        unit = n / mass
        log_sum = n * F.ln(mass / n) + logs
        s1, s2 = unit * inv, unit * unit * sq
        lean = [F.col(f"_d{i}") / mass for i in range(p)]
        turn = {(i, j): F.col(f"_d{i}_{j}") / mass for i, j in cells}
    else:
        log_sum, s1, s2 = n * F.ln(total), n / total, n / (total * total)
        lean = [F.lit(0.0)] * p
        turn = {c: F.lit(0.0) for c in cells}
    # Each risk sum minus its tied share is a line a + b u in the remaining mass u.
    rest = [F.col(f"r{i}") - total * lean[i] for i in range(p)]
    risk = risk.select(
        (F.col("eta_dead") - log_sum).alias("ll"),
        *[(F.col(f"s{i}") - rest[i] * s1 - lean[i] * n).alias(f"g{i}") for i in range(p)],
        *[
            (
                (F.col(f"r{i}_{j}") - total * turn[i, j]) * s1
                + turn[i, j] * n
                - rest[i] * rest[j] * s2
                - (rest[i] * lean[j] + rest[j] * lean[i]) * s1
                - lean[i] * lean[j] * n
            ).alias(f"h{i}_{j}")
            for i, j in cells
        ],
    )
    row = risk.agg(*[F.sum(c).alias(c) for c in risk.columns]).first()
    if row["ll"] is None:
        raise ValueError("no events")
    info = np.empty((p, p))
    for i, j in cells:
        info[i, j] = info[j, i] = row[f"h{i}_{j}"]
    return row["ll"], np.array([row[f"g{i}"] for i in range(p)]), info


COX_SCHEMA = (
    "term string, coef double, hazard_ratio double, se double, z double, p double, "
    "ci_lo double, ci_hi double, loglik double, converged boolean"
)


@dataclass
class CoxFit:
    """A fitted model; ``rows`` has the distinct rows as t, e, x0, x1, ... and their number m."""

    names: list[str]
    rows: DataFrame
    beta: np.ndarray
    info: np.ndarray
    loglik: float
    loglik_null: float
    converged: bool


def fit_cox(
    df: DataFrame,
    t: str = "T",
    e: str = "E",
    x: Sequence[str] = ("arm",),
    ties: str = "efron",
    max_iter: int = 30,
    tol: float = 1e-9,
) -> CoxFit:
    """Proportional-hazards regression by Newton steps, one Spark job each.

    A step groups by time and runs the risk sums over pieces of the distinct
    times; one row of sums reaches the driver.  Equal rows are merged into counts
    beforehand.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"unknown ties {ties}")
    p = len(x)
    names = [f"x{i}" for i in range(p)]
    merged = (
        df_known(df, [t, e, *x])
        .select(
            F.col(t).cast("double").alias("t"),
            F.col(e).cast("int").alias("e"),
            *[F.col(c).cast("double").alias(n) for c, n in zip(x, names)],
        )
        .groupBy("t", "e", *names)
        .agg(F.count(F.lit(1)).alias("m"))
    )
    kept = in_pieces(cut_lineage(merged), "t")
    means = kept.agg(*[F.avg(n).alias(n) for n in names]).first()
    rows = kept.withColumns({n: F.col(n) - F.lit(means[n] or 0.0) for n in names})
    beta = np.zeros(p)
    null, gradient, info = _cox_step(rows, beta, ties)
    ll, converged = null, False
    for _ in range(max_iter):
        step = np.linalg.solve(info, gradient)
        for _ in range(10):
            new = _cox_step(rows, beta + step, ties)
            if math.isfinite(new[0]) and new[0] >= ll - 1e-12 * abs(ll):
                break
            step = step / 2
        beta, gain = beta + step, new[0] - ll
        ll, gradient, info = new
        if abs(gain) < tol and np.abs(step).max() < 1e-6:
            converged = True
            break
    return CoxFit(list(x), kept.drop("_piece"), beta, info, ll, null, converged)


def cox_ph(
    df: DataFrame,
    t: str = "T",
    e: str = "E",
    x: Sequence[str] = ("arm",),
    ties: str = "efron",
    max_iter: int = 30,
    tol: float = 1e-9,
) -> DataFrame:
    """Coefficient table of a proportional-hazards regression, see ``fit_cox``."""
    fit = fit_cox(df, t, e, x, ties, max_iter, tol)
    se = np.sqrt(np.diag(np.linalg.inv(fit.info)))
    out = [
        (
            name,
            float(b),
            float(math.exp(b)),
            float(s),
            float(b / s),
            normal_two_sided(b / s),
            float(b - Z95 * s),
            float(b + Z95 * s),
            float(fit.loglik),
            fit.converged,
        )
        for name, b, s in zip(fit.names, fit.beta, se)
    ]
    return df.sparkSession.createDataFrame(out, COX_SCHEMA)


def concordance(
    df: DataFrame, t: str = "T", e: str = "E", score: str = "score", weight: str | None = None
) -> DataFrame:
    """Pairs that can be compared, and those whose higher ``score`` came first: one row.

    Two patients compare if the earlier of them had the event; of one time, if
    just one had it, who counts as earlier.  Equal scores are ``tied`` and count
    half in ``concordance``, which is NULL without comparable pairs.  Rows with a
    NULL are left out; ``weight`` counts a row that often.

    No pair is ever listed.  Two places in the order of time part at exactly one
    level of halving that order, so at each level the events of the left half of
    a block meet the running counts of its right half by score: rows times the
    logarithm of the distinct times, in aggregates and windows over pieces of the
    scores.
    """
    known = df_known(df, [c for c in (t, e, score, weight) if c])
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    merged = known.groupBy(
        F.col(t).cast("double").alias("t"),
        F.col(e).cast("int").alias("e"),
        F.col(score).cast("double").alias("s"),
    ).agg(number.cast("decimal(38,0)").alias("m"))
    kept = cut_lineage(merged)
    times = in_pieces(cut_lineage(kept.select("t").distinct()), "t").withColumn("_one", F.lit(1))
    ranked = running_totals(times, [], "t", {"k": "_one"}, F.col("_piece")).select("t", "k")
    # At one time the event comes before the censored patients.
    pos = 2 * F.col("k") + F.when(F.col("e") == 1, 0).otherwise(1)
    placed = in_pieces(kept, "s").withColumnRenamed("_piece", "_strip").join(ranked, "t")
    placed = cut_lineage(placed.select("s", "m", "e", "_strip", pos.cast("bigint").alias("pos")))
    last = placed.agg(F.max("pos")).first()[0] or 0
    level, side = F.col("level"), F.expr("shiftright(pos, level) & 1")
    halves = (
        placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last.bit_length()))))
        .withColumn("right", side == 1)
        .where(F.col("right") | (F.col("e") == 1))
        .groupBy(level, F.expr("shiftright(pos, level + 1)").alias("block"), "_strip", "s")
        .agg(
            F.sum(F.when(~F.col("right"), F.col("m")).otherwise(0)).cast("decimal(38,0)").alias("asked"),
            F.sum(F.when(F.col("right"), F.col("m")).otherwise(0)).cast("decimal(38,0)").alias("held"),
        )
    )
    halves = cut_lineage(halves)
    by = ["level", "block"]
    totals = halves.groupBy(*by).agg(F.sum("asked").alias("asked"), F.sum("held").alias("held"))
    ranked = running_totals(halves, by, "s", {"upto": "held"}, F.col("_strip"))

    def whole(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")

    asked, held = (F.col(c).cast("decimal(19,0)") for c in ("asked", "held"))
    lower = (F.col("upto") - F.col("held")).cast("decimal(19,0)")
    counted = ranked.agg(whole(asked * lower).alias("concordant"), whole(asked * held).alias("tied"))
    pairs = totals.agg(whole(asked * held).alias("comparable"))
    n = F.col("comparable").cast("double")
    share = F.try_divide(F.col("concordant").cast("double") + F.col("tied").cast("double") / 2, n)
    # Both sides are one row.
    return counted.crossJoin(F.broadcast(pairs)).withColumn("concordance", share)


def cox_summary(
    df: DataFrame,
    t: str = "T",
    e: str = "E",
    x: Sequence[str] = ("arm",),
    ties: str = "efron",
) -> DataFrame:
    """The figures of a fitted model as a whole, one row.

    Patients and events, log-likelihoods without and with the covariates, their
    likelihood-ratio test, partial AIC, and how well the fitted hazard orders the
    patients.
    """
    fit = fit_cox(df, t, e, x, ties)
    p = len(fit.names)
    chi2 = 2.0 * (fit.loglik - fit.loglik_null)
    hazard = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(fit.beta)), F.lit(0.0))
    pairs = concordance(fit.rows.withColumn("_hazard", hazard), "t", "e", "_hazard", weight="m")
    size = fit.rows.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("e")).alias("events"))
    return size.crossJoin(F.broadcast(pairs)).select(
        "n",
        "events",
        F.lit(float(fit.loglik_null)).alias("loglik_null"),
        F.lit(float(fit.loglik)).alias("loglik"),
        F.lit(chi2).alias("chi2"),
        F.lit(p).alias("df"),
        F.lit(chi2_tail(chi2, p)).alias("p"),
        F.lit(2.0 * p - 2.0 * float(fit.loglik)).alias("partial_aic"),
        "concordant",
        "tied",
        "comparable",
        "concordance",
    )
