"""Queries over models, survival, clusters, series and the jobs built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.columns import complete_cases, rejected_keys
from cohortflow.operators import cgm, clusters, mixed, neighbours, series, survival
from cohortflow.operators.joins import attach
from cohortflow.operators.shape import rounded
from cohortflow.plans import bindings as B
from cohortflow.plans import jobs
from cohortflow.plans.bindings import with_frames
from cohortflow.plans.matrix_sql import cox_ctes, mixed_ctes
from cohortflow.plans.queries_longitudinal import METRIC_FRAMES, METRICS_SQL, NORMAL_TAIL
from cohortflow.plans.registry import day_sql, query, r, ts_sql, ts_text
from cohortflow.session import cut_lineage, scratch_path
from cohortflow.sources import tables as T

# Mixed models.

TERMS = ["week*arm", "base"]
FORMULAS = {
    "slope": ["week*arm"],
    "baseline": ["week*arm", "base"],
    "drug": ["week*arm", "base", "drug"],
    "drug_slope": ["week*arm", "base", "week*drug"],
    "three_way": ["week*arm*drug", "base"],
}


def outcome(spark: SparkSession, base: str) -> DataFrame:
    return complete_cases(B.weekly_outcome(spark, base), ["y", "base"])


def _stat_cells(z: list[str]) -> tuple[str, str]:
    cells = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    rows = ", ".join(f"sum({z[i]} * {z[j]}) AS w_{i}_{j}" for i, j in cells)
    groups = ", ".join(
        f"round(sum(w_{i}_{j}), 2) AS w_{i}_{j}, round(sum(z{i} * z{j}), 2) AS b_{i}_{j}" for i, j in cells
    )
    sums = ", ".join(f"sum({c}) AS z{i}" for i, c in enumerate(z))
    return f"{rows}, {sums}", groups


Z = ["1.0::DOUBLE", "week::DOUBLE", "arm::DOUBLE", "week::DOUBLE * arm", "y"]


@query(
    "STAT2_sufficient_statistics",
    with_frames(
        f"""SELECT size, count(*) AS groups, {_stat_cells(Z)[1]} FROM (SELECT patient_id, count(*) AS size,
        {_stat_cells(Z)[0]} FROM weekly_outcome WHERE base IS NOT NULL GROUP BY 1) GROUP BY 1""",
        "weekly_outcome",
    ),
)
def sufficient_statistics(spark: SparkSession, base: str) -> DataFrame:
    df = outcome(spark, base)
    columns = mixed.design_columns(df, ["week*arm"])
    return rounded(mixed.sufficient_statistics(df, "y", columns, "patient_id"), 2)


def _fit_ctes(x: str, by: str = "'all'", reml: bool = False, frame: str = "outcome") -> dict[str, str]:
    """The one-covariate model in SQL: bisection on the slope of the profile likelihood."""
    q = {
        "q11": ("c * size", "c * size * size"),
        "q1x": ("sx", "size * sx"),
        "q1y": ("sy", "size * sy"),
        "qxx": ("wxx", "bxx"),
        "qxy": ("wxy", "bxy"),
        "qyy": ("wyy", "byy"),
    }
    sums = ", ".join(
        f"sum({w} - theta / (1 + size * theta) * {b}) AS {n}, sum(-1 / pow(1 + size * theta, 2) * {b}) AS d{n[1:]}"
        for n, (w, b) in q.items()
    )
    solved = f"""SELECT *, (qxx * q1y - q1x * qxy) / det AS b0, (q11 * qxy - q1x * q1y) / det AS b1
        FROM (SELECT *, q11 * qxx - q1x * q1x AS det, obs - {2 if reml else 0} AS free FROM (
            SELECT stratum, theta, {{keep}} sum(c * size) AS obs, sum(c) AS n_groups, {sums},
            sum(c * ln(1 + size * theta)) AS logv, sum(c * size / (1 + size * theta)) AS dlogv
            FROM {{source}} JOIN sizes USING (stratum) GROUP BY ALL))"""
    change = "(d11 * b0 * b0 + 2 * d1x * b0 * b1 + dxx * b1 * b1 - 2 * b0 * d1y - 2 * b1 * dxy + dyy)"
    trace = "(qxx * d11 + q11 * dxx - 2 * q1x * d1x) / det" if reml else "0"
    step = solved.format(
        keep="lo, hi, step,",
        source="(SELECT *, (lo + hi) / 2 / (1 - (lo + hi) / 2) AS theta FROM search WHERE step < 60)",
    )
    slope = f"-0.5 * {change} * free / (qyy - b0 * q1y - b1 * qxy) - 0.5 * dlogv - 0.5 * {trace} > 0"
    log_det = "ln(det)" if reml else "0"
    return {
        "outcome": "SELECT * FROM weekly_outcome WHERE base IS NOT NULL",
        "sizes": f"""SELECT stratum, size::DOUBLE AS size, count(*)::DOUBLE AS c, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS wxx,
            sum(sxy) AS wxy, sum(syy) AS wyy, sum(sx * sx) AS bxx, sum(sx * sy) AS bxy, sum(sy * sy) AS byy
            FROM (SELECT {by} AS stratum, patient_id, count(*) AS size, sum({x}::DOUBLE) AS sx, sum(y) AS sy,
                sum({x}::DOUBLE * {x}) AS sxx, sum({x} * y) AS sxy, sum(y * y) AS syy FROM {frame} GROUP BY 1, 2)
            GROUP BY 1, 2""",
        "search": f"""SELECT DISTINCT stratum, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM sizes
            UNION ALL SELECT stratum, CASE WHEN {slope} THEN (lo + hi) / 2 ELSE lo END,
            CASE WHEN {slope} THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM ({step})""",
        "fitted": f"""SELECT *, scale * theta AS group_var, -0.5 * (free * ln(2 * pi() * scale) + logv + free)
            - 0.5 * {log_det} AS loglik FROM (SELECT *, (qyy - b0 * q1y - b1 * qxy) / free AS scale FROM ({solved.format(
            keep="", source="(SELECT stratum, (lo + hi) / 2 / (1 - (lo + hi) / 2) AS theta FROM search WHERE step = 60)")}))""",
        "terms": f"""SELECT stratum, 'Intercept' AS term, b0 AS coef, sqrt(scale * qxx / det) AS se FROM fitted
            UNION ALL SELECT stratum, '{x}', b1, sqrt(scale * q11 / det) FROM fitted""",
        "tested": "SELECT *, coef / se AS z FROM terms",
    }


COEF_COLUMNS = f"""term, {r('coef', 'se', 'z', digits=5)}, round({NORMAL_TAIL}, 6) AS p,
    round(coef - 1.959963984540054::DOUBLE * se, 5) AS ci_lo,
    round(coef + 1.959963984540054::DOUBLE * se, 5) AS ci_hi"""
SUMMARY_COLUMNS = f"""CAST(obs AS BIGINT) AS n_obs, CAST(n_groups AS BIGINT) AS n_groups,
    {r('group_var', 'scale', 'loglik', digits=4)}, round(-2 * (loglik - 4), 4) AS aic"""


def rounded_coefficients(df: DataFrame) -> DataFrame:
    return rounded(df, {c: 5 for c in ("coef", "se", "z", "ci_lo", "ci_hi")})


@query("STAT2_mixed_lm", with_frames(f"SELECT {COEF_COLUMNS} FROM tested", "weekly_outcome", extra=_fit_ctes("week")))
def mixed_lm(spark: SparkSession, base: str) -> DataFrame:
    return rounded_coefficients(mixed.mixed_lm(outcome(spark, base), "y", ["week"], "patient_id"))


@query(
    "STAT2_mixed_lm_reml",
    with_frames(f"SELECT {COEF_COLUMNS} FROM tested", "weekly_outcome", extra=_fit_ctes("week", reml=True)),
)
def mixed_lm_reml(spark: SparkSession, base: str) -> DataFrame:
    return rounded_coefficients(mixed.mixed_lm(outcome(spark, base), "y", ["week"], "patient_id", reml=True))


@query(
    "STAT2_model_summary",
    with_frames(f"SELECT {SUMMARY_COLUMNS} FROM fitted", "weekly_outcome", extra=_fit_ctes("arm", reml=True)),
)
def model_summary(spark: SparkSession, base: str) -> DataFrame:
    fits = mixed.fit_mixed(outcome(spark, base), "y", ["arm"], "patient_id", reml=True)
    return rounded(mixed.summaries(spark, fits), 4)


OUTCOME = {"outcome": "SELECT * REPLACE (drug::INTEGER AS drug) FROM weekly_outcome WHERE base IS NOT NULL"}
COVARIATES = {"week": "week", "arm": "arm", "base": "base", "week:arm": "week * arm"}


@query(
    "STAT2_mixed_lm_covariates",
    with_frames(
        f"SELECT {COEF_COLUMNS} FROM tested",
        "weekly_outcome",
        extra={**OUTCOME, **mixed_ctes(COVARIATES, "outcome")},
    ),
)
def mixed_lm_covariates(spark: SparkSession, base: str) -> DataFrame:
    return rounded_coefficients(mixed.mixed_lm(outcome(spark, base), "y", TERMS, "patient_id"))


@query(
    "STAT2_group_variance",
    with_frames(
        """SELECT round(group_var, 4) AS group_var, round(scale, 4) AS scale, round(theta, 5) AS ratio,
        round(sqrt(i22 / det), 5) AS ratio_se,
        round(sqrt((scale * scale * i22 - 2 * scale * theta * i12 + theta * theta * i11) / det), 4) AS group_var_se,
        true AS converged FROM (SELECT *, i11 * i22 - i12 * i12 AS det FROM informed)""",
        "weekly_outcome",
        extra={**OUTCOME, **mixed_ctes({"week": "week", "arm": "arm"}, "outcome")},
    ),
)
def group_variance(spark: SparkSession, base: str) -> DataFrame:
    out = mixed.variances(outcome(spark, base), "y", ["week", "arm"], "patient_id")
    return rounded(out, {"group_var": 4, "scale": 4, "group_var_se": 4, "ratio": 5, "ratio_se": 5})


def sites(spark: SparkSession, base: str) -> DataFrame:
    """The weekly outcome with a category of five levels."""
    site = F.concat(F.lit("S"), (F.col("patient_id") % 5).cast("string"))
    return outcome(spark, base).withColumn("site", site)


SITES = {
    **OUTCOME,
    "sites": "SELECT *, 'S' || patient_id % 5 AS site FROM outcome",
}
LEVELS = ("S0", "S1", "S2", "S3", "S4")
BY_SITE = {"week": "week", **{f"site={s}": f"(site = '{s}')::INTEGER" for s in LEVELS[1:]}}


@query(
    "STAT2_mixed_lm_category",
    with_frames(
        f"SELECT {COEF_COLUMNS} FROM tested",
        "weekly_outcome",
        extra={**SITES, **mixed_ctes(BY_SITE, "sites")},
    ),
)
def mixed_lm_category(spark: SparkSession, base: str) -> DataFrame:
    fits = mixed.fit_mixed(sites(spark, base), "y", ["week", "site"], "patient_id", levels={"site": LEVELS})
    return rounded_coefficients(mixed.coefficients(spark, fits))


@query(
    "STAT6_predict_category",
    with_frames(
        f"""SELECT patient_id, week, round(list_sum(list_transform(range({len(BY_SITE) + 1}),
            lambda i: s[i * {len(BY_SITE) + 2} + {len(BY_SITE) + 2}] * z[i + 1])), 4) AS predicted
        FROM (SELECT patient_id, week, [1::DOUBLE, {', '.join(f'({c})::DOUBLE' for c in BY_SITE.values())}] AS z
            FROM sites WHERE site IN ('S1', 'S4')), fitted""",
        "weekly_outcome",
        extra={**SITES, **mixed_ctes(BY_SITE, "sites")},
    ),
)
def predict_category(spark: SparkSession, base: str) -> DataFrame:
    """Fitted on all rows, predicted on the rows of two levels."""
    df = sites(spark, base)
    fit = mixed.fit_mixed(df, "y", ["week", "site"], "patient_id")[0]
    some = df.where(F.col("site").isin("S1", "S4"))
    out = mixed.predict_mixed(some, ["week", "site"], fit)
    return rounded(out.select("patient_id", "week", "predicted"), {"predicted": 4})


@query(
    "STAT3_design",
    with_frames(
        """SELECT patient_id, week::DOUBLE AS week, a::DOUBLE AS "arm=with", drug::INTEGER::DOUBLE AS "drug=True",
        (week * a)::DOUBLE AS "week:arm=with", (week * drug::INTEGER)::DOUBLE AS "week:drug=True",
        (a * drug::INTEGER)::DOUBLE AS "arm=with:drug=True",
        (week * a * drug::INTEGER)::DOUBLE AS "week:arm=with:drug=True", round(base, 6) AS base
        FROM (SELECT *, 1 - arm AS a FROM weekly_outcome)""",
        "weekly_outcome",
    ),
)
def design(spark: SparkSession, base: str) -> DataFrame:
    label = F.when(F.col("arm") == 1, "none").otherwise("with")
    df = B.weekly_outcome(spark, base).withColumn("arm", label)
    return rounded(mixed.design(df, ["week*arm*drug", "base"], keep=["patient_id"]))


@query(
    "STAT4_mixed_lm_by",
    with_frames(
        f"SELECT stratum AS drug, {COEF_COLUMNS} FROM tested",
        "weekly_outcome",
        extra=_fit_ctes("week", "CASE WHEN drug THEN 'True' ELSE 'False' END"),
    ),
)
def mixed_lm_by(spark: SparkSession, base: str) -> DataFrame:
    return rounded_coefficients(
        mixed.mixed_lm_by(outcome(spark, base), "drug", "y", ["week"], "patient_id")
    )


def _compared(names: list[str]) -> str:
    fits = [
        f"SELECT '{n}' AS model, * FROM ("
        + with_frames(f"SELECT {SUMMARY_COLUMNS} FROM fitted", "weekly_outcome", extra=_fit_ctes(n))
        + ")"
        for n in names
    ]
    return " UNION ALL ".join(fits)


@query("STAT5_compare_models", _compared(["week", "arm", "base"]))
def compare_models(spark: SparkSession, base: str) -> DataFrame:
    formulas = {n: [n] for n in ("week", "arm", "base")}
    return rounded(mixed.compare_models(outcome(spark, base), "y", formulas, "patient_id"), 4)


def _formulas_sql() -> str:
    """One fit per formula; ``a*b*c`` is written out as its products."""
    fits = []
    for name, terms in FORMULAS.items():
        products = {":".join(t): " * ".join(t) for t in mixed._expand(terms)}
        columns = f"""CAST(obs AS BIGINT) AS n_obs, CAST(n_groups AS BIGINT) AS n_groups,
            {r('group_var', 'scale', 'loglik', digits=4)}, round(-2 * (loglik - p - 2), 4) AS aic"""
        body = with_frames(
            f"SELECT {columns} FROM fitted",
            "weekly_outcome",
            extra={**OUTCOME, **mixed_ctes(products, "outcome")},
        )
        fits.append(f"SELECT '{name}' AS model, * FROM ({body})")
    return " UNION ALL ".join(fits)


@query("STAT5_compare_formulas", _formulas_sql())
def compare_formulas(spark: SparkSession, base: str) -> DataFrame:
    return rounded(mixed.compare_models(outcome(spark, base), "y", FORMULAS, "patient_id"), 4)


@query(
    "STAT6_predict_mixed",
    with_frames(
        """SELECT patient_id, week, round(y, 6) AS y, round(b0 + b1 * week, 5) AS predicted
        FROM outcome, fitted""",
        "weekly_outcome",
        extra=_fit_ctes("week"),
    ),
)
def predict_mixed(spark: SparkSession, base: str) -> DataFrame:
    df = outcome(spark, base)
    fit = mixed.fit_mixed(df, "y", ["week"], "patient_id")[0]
    out = mixed.predict_mixed(df, ["week"], fit).select("patient_id", "week", "y", "predicted")
    return rounded(out, {"predicted": 5})


# Survival.

REBOUND = """SELECT patient_id, CAST(coalesce(hit, last_week, lo_week) - lo_week AS DOUBLE) AS T,
    CASE WHEN hit IS NULL THEN 0 ELSE 1 END AS E, base, arm
    FROM (SELECT patient_id, any_value(lo_week) AS lo_week, any_value(b) AS base, any_value(arm) AS arm,
        min(week) FILTER (WHERE week > lo_week AND y >= lo + (b - lo) * 0.9::DOUBLE) AS hit,
        max(week) FILTER (WHERE week > lo_week) AS last_week
        FROM (SELECT *, min(base) OVER p AS b, min(y) OVER p AS lo, first(week) OVER (PARTITION BY patient_id
            ORDER BY y, week) AS lo_week FROM weekly_outcome WHERE base IS NOT NULL
            WINDOW p AS (PARTITION BY patient_id)) GROUP BY 1)"""


def rebounds(spark: SparkSession, base: str) -> DataFrame:
    return survival.rebound_events(
        B.weekly_outcome(spark, base), 0.9, value="y", base="base", covariates=["arm"]
    )


@query(
    "SURV1_rebound_events",
    with_frames(f"SELECT patient_id, T, E, arm, round(base, 6) AS base FROM ({REBOUND})", "weekly_outcome"),
)
def rebound_events(spark: SparkSession, base: str) -> DataFrame:
    return rounded(rebounds(spark, base))


def curve_sql(frame: str) -> str:
    return f"""SELECT arm, T, at_risk, events, leaving - events AS censored, round(s, 6) AS survival,
        round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.959963984540054::DOUBLE * sqrt(v) / ln(s))) ELSE s END, 6) AS ci_lo,
        round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.959963984540054::DOUBLE * sqrt(v) / ln(s))) ELSE s END, 6) AS ci_hi
        FROM (SELECT *, CASE WHEN bool_or(events = at_risk) OVER w THEN 0
            ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS s,
            sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS v
            FROM (SELECT *, CAST(sum(leaving) OVER (PARTITION BY arm ORDER BY T DESC) AS BIGINT) AS at_risk
                FROM (SELECT arm, T, count(*) AS leaving, CAST(sum(E) AS BIGINT) AS events
                    FROM {frame} GROUP BY 1, 2))
            WINDOW w AS (PARTITION BY arm ORDER BY T))"""


@query("SURV2_kaplan_meier", with_frames(curve_sql("survival"), "survival"))
def kaplan_meier(spark: SparkSession, base: str) -> DataFrame:
    return rounded(survival.kaplan_meier(B.survival_frame(spark, base)))


LOGRANK = """SELECT sum(d1)::DOUBLE AS observed, sum(d * n1 / n) AS expected,
    sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance
    FROM (SELECT T, sum(E)::DOUBLE AS d, sum(E * arm)::DOUBLE AS d1,
        (sum(count(*)) OVER (ORDER BY T DESC))::DOUBLE AS n,
        (sum(sum(arm)) OVER (ORDER BY T DESC))::DOUBLE AS n1 FROM survival GROUP BY 1)"""


@query(
    "SURV3_logrank",
    with_frames(
        f"""SELECT {r('observed', 'expected', 'variance', 'chi2')}, round({NORMAL_TAIL}, 6) AS p
        FROM (SELECT *, pow(observed - expected, 2) / variance AS chi2,
            abs(observed - expected) / sqrt(variance) AS z FROM ({LOGRANK}))""",
        "survival",
    ),
)
def logrank(spark: SparkSession, base: str) -> DataFrame:
    return rounded(survival.logrank(B.survival_frame(spark, base), 1))


def _cox_ctes(frame: str) -> dict[str, str]:
    """Newton steps for a 0/1 covariate with Efron ties, one row per event and tie."""
    share = "(n1 - l / d * d1) * exp(b) / (n0 - l / d * d0 + (n1 - l / d * d1) * exp(b))"
    return {
        "times": f"""SELECT T, sum(E * arm)::DOUBLE AS d1, sum(E * (1 - arm))::DOUBLE AS d0,
            (sum(sum(arm)) OVER (ORDER BY T DESC))::DOUBLE AS n1,
            (sum(sum(1 - arm)) OVER (ORDER BY T DESC))::DOUBLE AS n0 FROM {frame} GROUP BY 1""",
        "ties": """SELECT *, d0 + d1 AS d, d1 / (d0 + d1) AS own,
            unnest(range(CAST(d0 + d1 AS BIGINT)))::DOUBLE AS l FROM times WHERE d0 + d1 > 0""",
        "newton": f"""SELECT 0 AS step, 0.0::DOUBLE AS b UNION ALL SELECT step + 1, b + u / i FROM (
            SELECT step, b, sum(own - p) AS u, sum(p * (1 - p)) AS i FROM (SELECT step, b, own, {share} AS p
            FROM newton JOIN ties ON step < 25) GROUP BY 1, 2)""",
        "cox": f"""SELECT 'arm' AS term, b AS coef, 1 / sqrt(sum(p * (1 - p))) AS se, sum(own * b - ln(total)) AS loglik
            FROM (SELECT b, own, {share} AS p, n0 - l / d * d0 + (n1 - l / d * d1) * exp(b) AS total
            FROM newton JOIN ties ON step = 25) GROUP BY b""",
        "tested": "SELECT *, coef / se AS z FROM cox",
    }


COX_COLUMNS = f"""term, {r('coef', 'se', 'z')}, round(exp(coef), 6) AS hazard_ratio,
    round({NORMAL_TAIL}, 6) AS p, round(coef - 1.959963984540054::DOUBLE * se, 6) AS ci_lo,
    round(coef + 1.959963984540054::DOUBLE * se, 6) AS ci_hi, round(loglik, 6) AS loglik, true AS converged"""


@query("SURV4_cox_ph", with_frames(f"SELECT {COX_COLUMNS} FROM tested", "survival", extra=_cox_ctes("survival")))
def cox_ph(spark: SparkSession, base: str) -> DataFrame:
    return rounded(survival.cox_ph(B.survival_frame(spark, base), x=["arm"]))


@query(
    "SURV4_cox_covariates",
    with_frames(f"SELECT {COX_COLUMNS} FROM tested", "survival", extra=cox_ctes(["arm", "age"], "survival")),
)
def cox_covariates(spark: SparkSession, base: str) -> DataFrame:
    return rounded(survival.cox_ph(B.survival_frame(spark, base), x=["arm", "age"]))


# Every pair of patients, the first of which had the event.
PAIRS = """SELECT count(*) FILTER (a.s > b.s) AS concordant, count(*) FILTER (a.s = b.s) AS tied,
    count(*) AS comparable FROM scored a JOIN scored b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0))"""
SHARE = "round((concordant + tied / 2.0::DOUBLE) / comparable, 6) AS concordance"
COUNTED = ["concordant", "tied", "comparable"]


def _counted(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.col(c).cast("bigint") for c in COUNTED}))


@query(
    "SURV4_concordance",
    with_frames(
        f"SELECT *, {SHARE} FROM ({PAIRS})",
        "survival",
        extra={"scored": "SELECT T AS t, E AS e, age - 3 * arm AS s FROM survival"},
    ),
)
def concordance(spark: SparkSession, base: str) -> DataFrame:
    scored = B.survival_frame(spark, base).withColumn("score", F.col("age") - 3 * F.col("arm"))
    return _counted(survival.concordance(scored))


@query(
    "SURV4_cox_summary",
    with_frames(
        f"""SELECT n, events, round(null_ll, 6) AS loglik_null, round(loglik, 6) AS loglik,
        round(2 * (loglik - null_ll), 6) AS chi2, 2 AS df, round(exp(-(loglik - null_ll)), 6) AS p,
        round(4 - 2 * loglik, 6) AS partial_aic, concordant, tied, comparable, {SHARE}
        FROM (SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS events FROM subjects),
        (SELECT any_value(loglik) AS loglik FROM tested), (SELECT logs AS null_ll FROM null_model), ({PAIRS})""",
        "survival",
        extra={
            **cox_ctes(["arm", "age"], "survival"),
            "scored": "SELECT t, e, beta[1] * x[2] + beta[2] * x[3] AS s FROM subjects, cox",
        },
    ),
)
def cox_summary(spark: SparkSession, base: str) -> DataFrame:
    return _counted(survival.cox_summary(B.survival_frame(spark, base), x=["arm", "age"]))


# Clusters of patients.


def metrics(spark: SparkSession, base: str) -> DataFrame:
    return cut_lineage(cgm.patient_metrics(B.readings(spark, base)))


@query("ML1_fit_clusters")
def fit_clusters(spark: SparkSession, base: str) -> DataFrame:
    df = metrics(spark, base)
    return clusters.score(clusters.fit_clusters(df), df).select("patient_id", "cluster")


@query("ML2_assign_clusters")
def assign_clusters(spark: SparkSession, base: str) -> DataFrame:
    df = metrics(spark, base)
    path = scratch_path(spark, "model")
    clusters.save_model(clusters.fit_clusters(df), path)
    model = clusters.load_model(path)
    return clusters.assign_clusters(model, df, B.patients(spark, base)).select("patient_id", "hospital", "cluster")


@query("ML3_project2d")
def project2d(spark: SparkSession, base: str) -> DataFrame:
    df = metrics(spark, base)
    return clusters.project2d(clusters.fit_clusters(df), df)


@query("ML4_cluster_profile")
def cluster_profile(spark: SparkSession, base: str) -> DataFrame:
    df = metrics(spark, base)
    return clusters.cluster_profile(clusters.fit_clusters(df), df)


SIMPLE = ("mean", "sd", "TIR", "TAR")


@query(
    "ML1_scaled_features",
    with_frames(
        """SELECT patient_id, round((mean - avg(mean) OVER ()) / stddev_samp(mean) OVER (), 6) AS mean,
        round((sd - avg(sd) OVER ()) / stddev_samp(sd) OVER (), 6) AS sd,
        round((TIR - avg(TIR) OVER ()) / stddev_samp(TIR) OVER (), 6) AS TIR,
        round((TAR - avg(TAR) OVER ()) / stddev_samp(TAR) OVER (), 6) AS TAR
        FROM (SELECT patient_id, avg(glucose) AS mean, stddev_samp(glucose) AS sd,
            avg(CASE WHEN glucose BETWEEN 3.9 AND 10 THEN 1 ELSE 0 END) AS TIR,
            avg(CASE WHEN glucose > 10 THEN 1 ELSE 0 END) AS TAR FROM risk GROUP BY 1)""",
        "risk",
    ),
)
def scaled_features(spark: SparkSession, base: str) -> DataFrame:
    return rounded(clusters.scaled_features(metrics(spark, base), SIMPLE, "patient_id"))


# Fixed numbers in place of a saved model: scales and centres that the fixture's patients lie around.
GIVEN = clusters.Centres(
    clusters.FEATURES,
    (22.0, 18.0, 0.8, 0.2, 0.1, 0.7, 5.0, 60.0, 0.5, 30.0),
    (6.0, 6.0, 0.2, 0.1, 0.1, 0.1, 4.0, 20.0, 0.3, 9.0),
    tuple(tuple(((7 * i + 3 * j) % 5 - 2) / 2.0 for j in range(10)) for i in range(3)),
)
METRICS_PLAIN = """SELECT m.patient_id, mean, sd, sd / mean AS cv, (n - vlow - low - high - vhigh) / n AS TIR,
    (vlow + low) / n AS TBR, (high + vhigh) / n AS TAR, lbgi, hbgi,
    CASE WHEN n >= 2 THEN coalesce(path, 0) / nullif(hours, 0) END AS MAG, MAGE
    FROM moments m LEFT JOIN (SELECT r.patient_id, sum(amplitude) AS path,
        avg(amplitude) FILTER (WHERE amplitude > sd) AS MAGE FROM runs r
        JOIN moments USING (patient_id) GROUP BY 1) s USING (patient_id)"""
COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in clusters.FEATURES)


def _given_frames() -> dict[str, str]:
    """Scaled features of complete patients and their nearest given centre."""
    g = GIVEN
    scaled = ", ".join(
        f"({f} - {m!r}::DOUBLE) / {s!r}::DOUBLE AS {f}" for f, m, s in zip(g.features, g.means, g.sds)
    )
    far = [" + ".join(f"pow({f} - ({v!r}::DOUBLE), 2)" for f, v in zip(g.features, c)) for c in g.centres]
    return {
        "plain": METRICS_PLAIN,
        "scaled": f"SELECT patient_id, {scaled} FROM plain WHERE {COMPLETE}",
        "labelled": f"""SELECT *, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster
            FROM (SELECT *, [{", ".join(far)}] AS d FROM scaled)""",
    }


@query(
    "ML1_centres_at_rest",
    with_frames(
        f"""SELECT count(*) AS n, 3::BIGINT AS n_clusters, 0::BIGINT AS n_nearer, 0::BIGINT AS n_away
        FROM plain WHERE {COMPLETE}""",
        "risk",
        extra={**METRIC_FRAMES, "plain": METRICS_PLAIN},
    ),
)
def centres_at_rest(spark: SparkSession, base: str) -> DataFrame:
    df = metrics(spark, base)
    return clusters.at_rest(clusters.fit_clusters(df), df)


@query(
    "ML2_given_centres",
    with_frames(
        "SELECT p.patient_id, hospital, cluster FROM patients p LEFT JOIN labelled l ON p.patient_id = l.patient_id",
        "risk",
        "patients",
        extra={**METRIC_FRAMES, **_given_frames()},
    ),
)
def given_centres(spark: SparkSession, base: str) -> DataFrame:
    labels = GIVEN.assign(metrics(spark, base)).select("patient_id", "cluster")
    return attach(B.patients(spark, base).select("patient_id", "hospital"), labels, "patient_id")


@query(
    "ML4_given_labels",
    with_frames(
        "SELECT cluster, count(*) AS n, "
        + ", ".join(f"round(avg({f}), 6) AS {f}" for f in clusters.FEATURES)
        + " FROM labelled GROUP BY 1",
        "risk",
        extra={**METRIC_FRAMES, **_given_frames()},
    ),
)
def given_labels(spark: SparkSession, base: str) -> DataFrame:
    return rounded(clusters.profile_of(GIVEN.assign(metrics(spark, base)), clusters.FEATURES))


def _components_frames() -> dict[str, str]:
    """Two principal components by squaring the correlation matrix until one direction is left."""
    p = len(clusters.FEATURES)
    scaled = ", ".join(f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER ()" for f in clusters.FEATURES)

    def times(a: str, b: str) -> str:
        return f"""list_transform(range({p * p}), lambda e: list_sum(list_transform(range({p}),
            lambda k: {a}[(e // {p}) * {p} + k + 1] * {b}[k * {p} + e % {p} + 1])))"""

    def shrunk(a: str) -> str:
        trace = f"list_sum(list_transform(range({p}), lambda t: {a}[t * {p + 1} + 1]))"
        return f"list_transform({a}, lambda v: v / {trace})"

    def direction(name: str, start: str) -> dict[str, str]:
        # The matrix tends to the product of the direction with itself: its longest column is taken.
        column = f"list_transform(range({p}), lambda i: m[i * {p} + top + 1])"
        return {
            f"{name}_powers": f"""SELECT 0 AS step, {shrunk("m")} AS m FROM {start} UNION ALL
                SELECT step + 1, {shrunk("m")} FROM (SELECT step, {times("m", "m")} AS m
                FROM {name}_powers WHERE step < 30)""",
            f"{name}_axis": f"""SELECT list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))
                * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v FROM (SELECT {column} AS v FROM (
                SELECT m, list_position(d, list_max(d)) - 1 AS top FROM (SELECT m,
                list_transform(range({p}), lambda t: m[t * {p + 1} + 1]) AS d FROM {name}_powers WHERE step = 30)))""",
        }

    return {
        "plain": METRICS_PLAIN,
        "zed": f"SELECT patient_id, [{scaled}] AS z FROM plain WHERE {COMPLETE}",
        "corr": f"""SELECT list(v ORDER BY e) AS m FROM (SELECT e, sum(z[e // {p} + 1] * z[e % {p} + 1]) /
            (count(*) - 1) AS v FROM zed, range({p * p}) t(e) GROUP BY 1)""",
        **direction("first", "corr"),
        # What the first direction holds is taken out.
        "rest": f"""SELECT list_transform(range({p * p}), lambda e: m[e + 1] - lambda_ * v[e // {p} + 1] * v[e % {p} + 1]) AS m
            FROM (SELECT m, v, list_sum(list_transform(range({p * p}),
                lambda e: m[e + 1] * v[e // {p} + 1] * v[e % {p} + 1])) AS lambda_ FROM corr, first_axis)""",
        **direction("second", "rest"),
    }


@query(
    "ML3_components",
    with_frames(
        f"""SELECT patient_id, round(list_sum(list_transform(range({len(clusters.FEATURES)}),
            lambda i: z[i + 1] * a.v[i + 1])), 5) AS pc1,
        round(list_sum(list_transform(range({len(clusters.FEATURES)}), lambda i: z[i + 1] * b.v[i + 1])), 5) AS pc2
        FROM zed, first_axis a, second_axis b""",
        "risk",
        extra={**METRIC_FRAMES, **_components_frames()},
    ),
)
def components(spark: SparkSession, base: str) -> DataFrame:
    df = metrics(spark, base)
    return rounded(clusters.project2d(clusters.fit_clusters(df), df).select("patient_id", "pc1", "pc2"), 5)


# Series.


@query(
    "SER1_series_windows",
    with_frames(
        """SELECT patient_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(count(*) AS INTEGER) AS n,
        string_agg(printf('%.2f', glucose), ',' ORDER BY ts, reading_id) AS v FROM readings
        WHERE glucose IS NOT NULL GROUP BY 1, 2""",
        "readings",
    ),
)
def series_windows(spark: SparkSession, base: str) -> DataFrame:
    df = series.series_windows(B.readings(spark, base))
    text = F.array_join(F.transform("v", lambda v: F.format_string("%.2f", v)), ",")
    return df.select("patient_id", F.date_format("start", "yyyy-MM-dd").alias("date"), "n", text.alias("v"))


def blocks(spark: SparkSession, base: str, keep: bool = True) -> DataFrame:
    return series.dtw_blocks(B.series(spark, base), keep=keep)


WARP_STEP = """list_reduce(list_transform(range(len(b)), lambda j: [j::DOUBLE]), lambda acc, y: list_append(acc,
    pow(a[i + 1] - b[CAST(y[1] AS BIGINT) + 1], 2) + CASE WHEN i = 0 THEN CASE WHEN len(acc) = 0 THEN 0 ELSE acc[-1] END
        WHEN len(acc) = 0 THEN row[1]
        ELSE least(acc[-1], row[len(acc)], row[len(acc) + 1]) END), []::DOUBLE[])"""


@query(
    "SER2_next_day_distances",
    with_frames(
        """SELECT patient_id, CAST(date AS VARCHAR) AS date, round(sqrt(row[-1]), 6) AS distance
        FROM warped WHERE i = len(a)""",
        "readings",
        extra={
            "arrays": """SELECT patient_id, CAST(ts AS DATE) AS date, list(glucose ORDER BY ts, reading_id) AS v
                FROM readings WHERE glucose IS NOT NULL GROUP BY 1, 2""",
            "warped": f"""SELECT x.patient_id, x.date, x.v AS a, y.v AS b, 0 AS i, []::DOUBLE[] AS row
                FROM arrays x JOIN arrays y ON x.patient_id = y.patient_id AND y.date = x.date + 1
                UNION ALL SELECT patient_id, date, a, b, i + 1, {WARP_STEP} FROM warped WHERE i < len(a)""",
        },
    ),
)
def next_day_distances(spark: SparkSession, base: str) -> DataFrame:
    df = series.next_window_distances(series.series_windows(B.readings(spark, base)))
    return rounded(df.select("patient_id", F.date_format("start", "yyyy-MM-dd").alias("date"), "distance"))


NEAREST = 5
# Every pair of the patients' weekly series by the recurrence of the path matrix, row by row.
NEAREST_FRAMES = {
    "arrays": "SELECT patient_id AS id, list(y ORDER BY week) AS v FROM weekly_outcome WHERE y IS NOT NULL GROUP BY 1",
    "warped": f"""SELECT x.id AS src, y.id AS dst, x.v AS a, y.v AS b, 0 AS i, []::DOUBLE[] AS row
        FROM arrays x JOIN arrays y ON x.id < y.id
        UNION ALL SELECT src, dst, a, b, i + 1, {WARP_STEP} FROM warped WHERE i < len(a)""",
    "pairs": "SELECT src, dst, sqrt(row[-1]) AS distance FROM warped WHERE i = len(a)",
    "edges": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place
        FROM (SELECT * FROM pairs UNION ALL SELECT dst, src, distance FROM pairs)) WHERE place <= {NEAREST}""",
}


def nearest(spark: SparkSession, base: str) -> DataFrame:
    weeks = B.weekly_outcome(spark, base).where("y IS NOT NULL")
    points = F.array_sort(F.collect_list(F.struct("week", "y")))
    rows = weeks.groupBy(F.col("patient_id").alias("id")).agg(F.transform(points, lambda p: p["y"]).alias("v"))
    return neighbours.nearest_series(rows, NEAREST, exact=True)


@query(
    "SER2_nearest_weeks",
    with_frames(
        f"SELECT src, dst, {r('distance')}, CAST(place AS INTEGER) AS rank FROM edges",
        "weekly_outcome",
        extra=NEAREST_FRAMES,
    ),
)
def nearest_weeks(spark: SparkSession, base: str) -> DataFrame:
    return rounded(nearest(spark, base))


@query(
    "SER3_graph_affinity",
    with_frames(
        f"""SELECT a, b, {r('weight')}, {r('sigma')} FROM (SELECT a, b, sigma,
        exp(-distance * distance / (2 * sigma * sigma)) AS weight
        FROM graph, (SELECT quantile_cont(distance, 0.5) AS sigma FROM graph))""",
        "weekly_outcome",
        extra={
            **NEAREST_FRAMES,
            "graph": """SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(distance) AS distance
                FROM edges GROUP BY 1, 2""",
        },
    ),
)
def graph_affinity(spark: SparkSession, base: str) -> DataFrame:
    near, sigma = neighbours.graph_affinity(nearest(spark, base))
    return rounded(near.withColumn("sigma", F.lit(sigma)))


@query("SER4_graph_labels")
def graph_labels(spark: SparkSession, base: str) -> DataFrame:
    near, _ = neighbours.graph_affinity(neighbours.nearest_series(B.series(spark, base)))
    return neighbours.graph_labels(near)


@query("SER2_dtw_distances")
def dtw_distances(spark: SparkSession, base: str) -> DataFrame:
    return series.distance_summary(blocks(spark, base, keep=False))


@query("SER3_rbf_affinity")
def rbf_affinity(spark: SparkSession, base: str) -> DataFrame:
    near, sigma = series.rbf_affinity(blocks(spark, base))
    degrees = series.affinity_degrees(near)
    pairs = degrees.select(F.explode(F.arrays_zip("ids", "v")).alias("e"))
    return pairs.select(F.col("e.ids").alias("id"), F.col("e.v").alias("degree"), F.lit(sigma).alias("sigma"))


@query("SER4_spectral_labels")
def spectral_labels(spark: SparkSession, base: str) -> DataFrame:
    near, _ = series.rbf_affinity(blocks(spark, base))
    return series.spectral_labels(near)


# Jobs.


EARLY = {
    "early": """SELECT r.* FROM readings r JOIN anchors USING (patient_id)
        WHERE floor(epoch(ts - enroll_ts) / 86400) BETWEEN 0 AND 6""",
    "risk": B.SQL["risk"].replace("FROM readings", "FROM early"),
    **METRIC_FRAMES,
}


@query("JOB3_early_metrics", with_frames(METRICS_SQL, "readings", "anchors", extra=EARLY))
def early_metrics(spark: SparkSession, base: str) -> DataFrame:
    early = cgm.first_days(B.readings(spark, base), B.anchors(spark, base))
    return rounded(cgm.patient_metrics(early), {"mean": 8, "lbgi": 5, "hbgi": 5, "MAGE": 7})


@query(
    "ML2_incomplete_patients",
    with_frames(
        f"""SELECT patient_id FROM ({METRICS_SQL}) WHERE sd IS NULL OR cv IS NULL OR MAG IS NULL
        OR MAGE IS NULL""",
        "readings",
        "anchors",
        extra={**EARLY, "early": EARLY["early"].replace("BETWEEN 0 AND 6", "= 0")},
    ),
)
def incomplete_patients(spark: SparkSession, base: str) -> DataFrame:
    first_day = cgm.first_days(B.readings(spark, base), B.anchors(spark, base), days=1)
    return rejected_keys(cgm.patient_metrics(first_day), "patient_id", clusters.FEATURES)


@query(
    "JOB3_given_centres",
    with_frames(
        "SELECT a.patient_id, cluster FROM anchors a LEFT JOIN labelled l ON a.patient_id = l.patient_id",
        "readings",
        "anchors",
        extra={**EARLY, **_given_frames()},
    ),
)
def early_given_centres(spark: SparkSession, base: str) -> DataFrame:
    out, _ = jobs.early_phenotype(B.readings(spark, base), B.anchors(spark, base), GIVEN)
    return out.select("patient_id", "cluster")


@query("JOB3_early_phenotype")
def early_phenotype(spark: SparkSession, base: str) -> DataFrame:
    out, _ = jobs.early_phenotype(B.readings(spark, base), B.anchors(spark, base))
    return out.select("patient_id", "cluster")


# Some records have no value, so that the first known one of a label is sought.
GAPS = "SELECT * REPLACE (CASE WHEN reading_id % 3 <> 0 THEN bmi END AS bmi) FROM exam"


def gaps(spark: SparkSession, base: str) -> DataFrame:
    return B.exam(spark, base).withColumn("bmi", F.when(F.col("reading_id") % 3 != 0, F.col("bmi")))


def latest_sql(days: int, late: str) -> str:
    end = "arg_max" if late == "last" else "arg_min"
    return f"""SELECT patient_id,
        arg_min(round(bmi, 6), day) FILTER (WHERE seq = 'baseline' AND bmi IS NOT NULL) AS baseline_bmi,
        {end}(round(bmi, 6), day) FILTER (WHERE seq = 'latest' AND bmi IS NOT NULL) AS latest_bmi,
        arg_min(grade, day) FILTER (WHERE seq = 'baseline' AND bmi IS NOT NULL) AS baseline_grade,
        {end}(grade, day) FILTER (WHERE seq = 'latest' AND bmi IS NOT NULL) AS latest_grade
        FROM (SELECT *, CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 24 THEN 'normal'
            WHEN bmi < 28 THEN 'overweight' WHEN bmi >= 28 THEN 'obese' END AS grade, CAST(ts AS DATE) AS day,
            CASE WHEN floor(epoch(ts - enroll_ts) / 86400) <= {days} THEN 'baseline' ELSE 'latest' END AS seq,
            row_number() OVER (PARTITION BY patient_id, CAST(ts AS DATE) ORDER BY ts DESC, reading_id DESC) AS rn
            FROM gaps JOIN anchors USING (patient_id) WHERE ts >= enroll_ts) WHERE rn = 1 GROUP BY 1"""


@query(
    "JOB4_baseline_latest",
    with_frames(latest_sql(10, "last"), "exam", "anchors", extra={"gaps": GAPS}),
)
def baseline_latest(spark: SparkSession, base: str) -> DataFrame:
    return rounded(jobs.baseline_latest(gaps(spark, base), B.anchors(spark, base), days=10))


@query(
    "JOB4_baseline_first_later",
    with_frames(latest_sql(10, "first"), "exam", "anchors", extra={"gaps": GAPS}),
)
def baseline_first_later(spark: SparkSession, base: str) -> DataFrame:
    return rounded(jobs.baseline_latest(gaps(spark, base), B.anchors(spark, base), days=10, latest="first"))


GRADE = """CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 24 THEN 'normal' WHEN bmi < 28
    THEN 'overweight' ELSE 'obese' END"""


@query(
    "JOB4_merged_sources",
    with_frames(
        f"""SELECT patient_id, round(min_by(bmi, ts), 6) AS first_bmi, min_by({GRADE}, ts) AS first_grade,
        CASE WHEN min(ts) < max(ts) THEN round(max_by(bmi, ts), 6) END AS last_bmi,
        CASE WHEN min(ts) < max(ts) THEN max_by({GRADE}, ts) END AS last_grade FROM bodies GROUP BY 1""",
        "bodies",
    ),
)
def merged_sources(spark: SparkSession, base: str) -> DataFrame:
    both = B.scale(spark, base).unionByName(B.exam(spark, base))
    return rounded(jobs.first_last_measure(both))


def starts(spark: SparkSession, base: str) -> DataFrame:
    return B.anchors(spark, base).select(
        "patient_id",
        F.col("enroll_ts").cast("date").cast("timestamp").alias("start_date"),
        F.col("enroll_ts").alias("paid_at"),
        (F.col("patient_id") % 2).cast("int").alias("arm"),
    )


def around_start(spark: SparkSession, base: str) -> DataFrame:
    """Prescriptions with ship dates moved into the study month, whole days apart."""
    df = B.prescriptions(spark, base)
    day = F.pmod(F.datediff("date", F.lit("1990-01-01")), F.lit(120)) - 60
    return df.withColumn("date", F.date_add(F.lit(B.ORIGIN).cast("date"), day).cast("timestamp"))


# Buckets of the frames that are kept by patient.
BUCKETS = 8


def stored_frames(spark: SparkSession, base: str) -> list[DataFrame]:
    """The four sources of the weight job, kept in the catalog by patient."""
    frames = {
        "scale": B.scale(spark, base),
        "starts": starts(spark, base),
        "exam": B.exam(spark, base),
        "prescriptions": around_start(spark, base),
    }
    out = []
    for name, df in frames.items():
        path = scratch_path(spark, name)
        out.append(T.save_by_key(df, path.rsplit("/", 1)[-1].replace("-", "_"), path, "patient_id", BUCKETS))
    return out


def frame_of(spark: SparkSession, base: str) -> DataFrame:
    return jobs.weight_frame(
        B.scale(spark, base), starts(spark, base), B.exam(spark, base), around_start(spark, base), "small ring"
    )


WEIGHT = {
    "starts": """SELECT patient_id, CAST(CAST(enroll_ts AS DATE) AS TIMESTAMP) AS start_date,
        enroll_ts AS paid_at, CAST(patient_id % 2 AS INTEGER) AS arm FROM anchors""",
    "weeks": """SELECT patient_id, start_date, week, arm, avg(bmi) AS bmi FROM (SELECT *,
        CAST(floor(days / 7) AS INTEGER) AS week FROM (SELECT *, floor(epoch(ts - start_date) / 86400) AS days
        FROM scale JOIN starts USING (patient_id) WHERE ts >= paid_at)) GROUP BY 1, 2, 3, 4""",
    "extra": """SELECT patient_id, arg_min(bmi, day) AS bmi FROM (SELECT *, CAST(ts AS DATE) AS day,
        row_number() OVER (PARTITION BY patient_id, CAST(ts AS DATE) ORDER BY ts DESC, reading_id DESC) AS rn
        FROM exam JOIN starts USING (patient_id) WHERE floor(epoch(ts - paid_at) / 86400) BETWEEN 0 AND 6)
        WHERE rn = 1 GROUP BY 1""",
    "users": """SELECT DISTINCT p.patient_id FROM prescriptions p JOIN starts USING (patient_id)
        WHERE contains(medicine, 'small ring') AND DATE '2024-01-01' + CAST(
            ((CAST(date AS DATE) - DATE '1990-01-01') % 120) - 60 AS INTEGER) - CAST(start_date AS DATE) BETWEEN -30 AND 30""",
    "framed": """SELECT w.patient_id, CAST(CAST(w.start_date AS DATE) AS VARCHAR) AS start_date, w.week, w.arm,
        w.bmi, coalesce(b.bmi, e.bmi) AS base_bmi, w.patient_id IN (SELECT patient_id FROM users) AS drug
        FROM weeks w LEFT JOIN weeks b ON w.patient_id = b.patient_id AND b.week = 0
        LEFT JOIN extra e ON w.patient_id = e.patient_id""",
}


CUT = """SELECT coalesce(min(week) FILTER (WHERE arms < 2) - 1, max(week)) AS last_week FROM (
    SELECT week, count(*) FILTER (WHERE n >= 2) AS arms FROM (SELECT week, arm,
    count(DISTINCT patient_id) AS n FROM framed GROUP BY 1, 2) GROUP BY 1)"""


def weight_frame_sql() -> str:
    return with_frames(
        """SELECT patient_id, start_date, week, arm, round(bmi, 6) AS bmi, round(base_bmi, 6) AS base_bmi, drug
        FROM framed""",
        "scale",
        "exam",
        "anchors",
        "prescriptions",
        extra=WEIGHT,
    )


@query("SRC5_stored_by_patient", weight_frame_sql())
def stored_by_patient(spark: SparkSession, base: str) -> DataFrame:
    df = jobs.weight_frame(*stored_frames(spark, base), "small ring", kept=True)
    return rounded(df.withColumn("start_date", F.date_format("start_date", "yyyy-MM-dd")))


@query(
    "JOB5_weight_frame",
    with_frames(
        """SELECT patient_id, start_date, week, arm, round(bmi, 6) AS bmi, round(base_bmi, 6) AS base_bmi, drug
        FROM framed""",
        "scale",
        "exam",
        "anchors",
        "prescriptions",
        extra=WEIGHT,
    ),
)
def weight_frame(spark: SparkSession, base: str) -> DataFrame:
    df = frame_of(spark, base).withColumn("start_date", F.date_format("start_date", "yyyy-MM-dd"))
    return rounded(df)


@query(
    "JOB5_weight_slope",
    with_frames(
        f"SELECT {COEF_COLUMNS} FROM tested",
        "scale",
        "exam",
        "anchors",
        "prescriptions",
        extra={
            **WEIGHT,
            "cut": CUT,
            **_fit_ctes("week"),
            "outcome": """SELECT patient_id, week, bmi AS y FROM framed, cut
                WHERE week <= last_week AND base_bmi IS NOT NULL""",
        },
    ),
)
def weight_slope(spark: SparkSession, base: str) -> DataFrame:
    fitted = jobs.weight_model(frame_of(spark, base), ["week"], min_n=2)
    return rounded_coefficients(mixed.coefficients(spark, fitted.fits))


WEIGHT_COLUMNS = {
    "week": "week", "arm": "arm", "base_bmi": "base_bmi", "drug=True": "drug::INTEGER", "week:arm": "week * arm",
}


@query(
    "JOB5_weight_model",
    with_frames(
        f"SELECT {COEF_COLUMNS} FROM tested",
        "scale",
        "exam",
        "anchors",
        "prescriptions",
        extra={
            **WEIGHT,
            "cut": CUT,
            "outcome": """SELECT patient_id, week, arm, base_bmi, drug, bmi AS y FROM framed, cut
                WHERE week <= last_week AND base_bmi IS NOT NULL""",
            **mixed_ctes(WEIGHT_COLUMNS, "outcome"),
        },
    ),
)
def weight_model(spark: SparkSession, base: str) -> DataFrame:
    fitted = jobs.weight_model(frame_of(spark, base), ["week*arm", "base_bmi", "drug"], min_n=2)
    return rounded_coefficients(mixed.coefficients(spark, fitted.fits))


def report(spark: SparkSession, base: str, covariates: list[str]) -> jobs.ReboundReport:
    weekly = B.weekly_outcome(spark, base).withColumn("drug", F.col("drug").cast("int"))
    return jobs.rebound_report(weekly, 0.9, value="y", base="base", covariates=covariates)


FOLLOWED = {"rebounds": f"SELECT * FROM ({REBOUND}) WHERE T > 0"}


@query("JOB6_rebound_curves", with_frames(curve_sql("rebounds"), "weekly_outcome", extra=FOLLOWED))
def rebound_curves(spark: SparkSession, base: str) -> DataFrame:
    return rounded(report(spark, base, []).curves)


@query(
    "JOB6_rebound_hazards",
    with_frames(
        f"SELECT {COX_COLUMNS} FROM tested", "weekly_outcome", extra={**FOLLOWED, **_cox_ctes("rebounds")}
    ),
)
def rebound_hazards(spark: SparkSession, base: str) -> DataFrame:
    return rounded(report(spark, base, ["arm"]).hazards)


@query(
    "JOB6_rebound_covariates",
    with_frames(
        f"SELECT {COX_COLUMNS} FROM tested",
        "weekly_outcome",
        extra={
            "followed": f"""SELECT r.*, (patient_id % 3 = 0)::INTEGER AS drug FROM ({REBOUND}) r WHERE T > 0""",
            **cox_ctes(["arm", "drug", "base"], "followed"),
        },
    ),
)
def rebound_covariates(spark: SparkSession, base: str) -> DataFrame:
    return rounded(report(spark, base, ["arm", "drug", "base"]).hazards)


def _wide_cell(source: str, measure: str, how: str, w: int) -> str:
    agg = f"max_by({measure}, ts)" if how == "last" else f"avg({measure})"
    return f"""round({agg} FILTER (WHERE source = '{source}' AND w = {w} AND {measure} IS NOT NULL), 6)
        AS {source}_{measure}_w{w + 1}"""


WIDE_CELLS = ", ".join(
    _wide_cell(s, m, h, w)
    for s, m, h in (
        ("exam", "weight", "last"),
        ("exam", "height", "last"),
        ("scale", "bmi", "last"),
        ("glucose", "glucose", "mean"),
        ("lab", "c5", "last"),
        ("lab", "c7", "last"),
    )
    for w in range(5)
)


@query(
    "JOB7_wide_table",
    with_frames(
        f"""SELECT a.patient_id, {ts_sql('a.enroll_ts').replace('AS a.enroll_ts', 'AS enroll_ts')}, w.* EXCLUDE (patient_id)
        FROM anchors a LEFT JOIN (SELECT patient_id, {WIDE_CELLS}
        FROM (SELECT *, CAST(floor(days / 7) AS INTEGER) AS w FROM (SELECT l.*,
            floor(epoch(ts - enroll_ts) / 86400) AS days FROM long l JOIN anchors USING (patient_id))
            WHERE days BETWEEN 0 AND 28) GROUP BY 1) w ON a.patient_id = w.patient_id""",
        "exam",
        "scale",
        "readings",
        "anchors",
        extra={
            "long": """SELECT 'exam' AS source, patient_id, ts, weight, height, NULL::DOUBLE AS bmi,
                NULL::DOUBLE AS glucose, NULL::DOUBLE AS c5, NULL::DOUBLE AS c7 FROM exam
                UNION ALL SELECT 'scale', patient_id, ts, NULL, NULL, bmi, NULL, NULL, NULL FROM scale
                UNION ALL SELECT 'glucose', patient_id, ts, NULL, NULL, NULL, glucose, NULL, NULL FROM readings
                UNION ALL SELECT 'lab', patient_id, ts, NULL, NULL, NULL, NULL,
                    CASE WHEN reading_id % 10 = 5 THEN glucose END, CASE WHEN reading_id % 10 = 7 THEN glucose END
                    FROM readings"""
        },
    ),
)
def wide_table(spark: SparkSession, base: str) -> DataFrame:
    readings = B.readings(spark, base)
    lab = readings.select(
        "patient_id",
        "ts",
        F.concat(F.lit("c"), (F.col("reading_id") % 10).cast("string")).alias("code"),
        F.col("glucose").alias("result"),
    )
    sources = {
        "exam": (B.exam(spark, base), ["weight", "height"], "last"),
        "scale": (B.scale(spark, base), ["bmi"], "last"),
        "glucose": (readings, ["glucose"], "mean"),
        "lab": (lab, ["result"], "last"),
    }
    df = jobs.wide_table(
        B.anchors(spark, base), sources, "enroll_ts", 7, 29, codes=("lab", ["c5", "c7"])
    )
    return rounded(df.withColumn("enroll_ts", F.date_format("enroll_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


@query(
    "JOB9_prescription_timeline",
    with_frames(
        f"""SELECT patient_id, {day_sql('date')}, medicine, oid, line, part, supplier, price, pres_days, n_medicines
        FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date DESC, oid DESC, line DESC,
            part DESC, supplier DESC, price DESC) AS rn FROM (SELECT p.* REPLACE (CAST(p.date AS DATE) AS date),
            CAST(floor(epoch(p.date - s.first_paid) / 86400) AS INTEGER) AS pres_days
            FROM prescriptions p JOIN (SELECT patient_id, min(paid_at) AS first_paid FROM orders_f GROUP BY 1) s
            USING (patient_id) WHERE contains(medicine, 'ring') AND medicine <> 'hot ring'))
        JOIN (SELECT patient_id, count(DISTINCT medicine) AS n_medicines FROM prescriptions
            WHERE contains(medicine, 'ring') AND medicine <> 'hot ring' GROUP BY 1) USING (patient_id) WHERE rn = 1""",
        "prescriptions",
        "orders_f",
    ),
)
def prescription_timeline(spark: SparkSession, base: str) -> DataFrame:
    first = B.orders_f(spark, base).groupBy("patient_id").agg(F.min("paid_at").alias("start_date"))
    df = jobs.prescription_timeline(
        B.prescriptions(spark, base), first, "ring", ["hot ring"], order=B.PRESCRIPTION_ORDER
    )
    cols = ["medicine", "oid", "line", "part", "supplier", "price", "pres_days", "n_medicines"]
    return df.select("patient_id", F.date_format("date", "yyyy-MM-dd").alias("date"), *cols)
