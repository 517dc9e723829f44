"""Random-intercept linear mixed models (STAT2 to STAT6).

With a random intercept the covariance of a group depends on its size only, so
one pass over the rows leaves a sum of squares and products per distinct group
size.  The variance ratio is then found on these p x p matrices.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.shape import Z95
from cohortflow.operators.tails import normal_two_sided
from cohortflow.session import cut_lineage

def _expand(terms: Sequence[str]) -> list[tuple[str, ...]]:
    """``a*b*c`` stands for all main effects and interactions, ``a:b`` for one product."""
    out: list[tuple[str, ...]] = []
    for term in terms:
        parts = tuple(p.strip() for p in term.split("*"))
        for size in range(1, len(parts) + 1):
            for subset in combinations(parts, size):
                out.append(tuple(v for p in subset for v in p.split(":")))
    unique = dict.fromkeys(out)
    return sorted(unique, key=len)


Levels = Mapping[str, Sequence]

# Levels of a category at most; the design is solved on the driver.
MOST_LEVELS = 1000


def category_levels(df: DataFrame, terms: Sequence[str], levels: Levels | None = None) -> dict[str, list]:
    """Levels of each text or flag column of the terms, in order; those not given are read, a scan each.

    A level adds a coefficient, so a column of more than MOST_LEVELS is an error.
    """
    kinds, given = dict(df.dtypes), dict(levels or {})
    names = dict.fromkeys(v for t in _expand(terms) for v in t)
    names = [n for n in names if kinds[n] in ("string", "boolean")]
    wanted = [n for n in names if n not in given]
    for n in wanted:
        found = df.where(F.col(n).isNotNull()).select(n).distinct().limit(MOST_LEVELS + 1).collect()
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{n} has more than {MOST_LEVELS} levels")
        given[n] = sorted(r[0] for r in found)
    return {n: list(given[n]) for n in names}


def design_columns(
    df: DataFrame, terms: Sequence[str], levels: Levels | None = None
) -> dict[str, Column]:
    """Design columns by name: numbers as they are, text and flags as 0/1 columns.

    The reference level of a category is the first one, if they are read the
    lowest in code-point order.  A value that is no level has NULL columns.
    """
    kinds, known = dict(df.dtypes), category_levels(df, terms, levels)

    def coded(name: str) -> list[tuple[str, Column]]:
        if kinds[name] not in ("string", "boolean"):
            return [(name, F.col(name).cast("double"))]
        listed = F.col(name).isin(known[name])
        return [
            (f"{name}={lev}", F.when(listed, (F.col(name) == F.lit(lev)).cast("double")))
            for lev in known[name][1:]
        ]

    codes = {v: coded(v) for v in {v for t in _expand(terms) for v in t}}
    out: dict[str, Column] = {}
    for term in _expand(terms):
        products = [("", None)]
        for name in term:
            products = [
                (f"{a}:{b}" if a else b, y if x is None else x * y)
                for a, x in products
                for b, y in codes[name]
            ]
        out.update({label: column for label, column in products})
    return out


def design(df: DataFrame, terms: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    columns = design_columns(df, terms)
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


@dataclass
class MixedFit:
    """Estimates of one model; every field has the size of the design, not of the data.

    ``levels`` are those of the categories at the fit, ``group_sizes`` the least,
    mean and greatest number of rows of a group.
    """

    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    group_var: float
    scale: float
    loglik: float
    n_obs: int
    n_groups: int
    stratum: object = None
    model: str = ""
    levels: dict[str, list] = field(default_factory=dict)
    group_sizes: tuple[int, float, int] = (0, 0.0, 0)
    converged: bool = True
    ratio_se: float | None = None
    group_var_se: float | None = None

    @property
    def ratio(self) -> float:
        """Group variance over the scale."""
        return self.group_var / self.scale

    @property
    def aic(self) -> float:
        return -2.0 * (self.loglik - (len(self.names) + 2))

    def coefficient_rows(self) -> list[tuple]:
        rows = []
        for name, b, se in zip(self.names, self.coef, np.sqrt(np.diag(self.cov))):
            z = b / se if se > 0 else math.nan
            p = normal_two_sided(z) if se > 0 else math.nan
            rows.append(
                (name, float(b), float(se), float(z), float(p), float(b - Z95 * se), float(b + Z95 * se))
            )
        return rows


COEF_SCHEMA = "term string, coef double, se double, z double, p double, ci_lo double, ci_hi double"
SUMMARY_SCHEMA = (
    "n_obs bigint, n_groups bigint, group_var double, scale double, loglik double, aic double"
)


def sufficient_statistics(
    df: DataFrame,
    y: str,
    columns: dict[str, Column],
    group: str,
    centre: Sequence[float] | None = None,
    by: str | None = None,
) -> DataFrame:
    """Per distinct group size: number of groups, sums of products of rows and of group sums.

    Columns ``w_i_j`` sum z_i z_j over rows and ``b_i_j`` sum the products of the
    group totals, for z = (1, design columns, y), with i <= j.
    """
    centre = list(centre) if centre is not None else [0.0] * (len(columns) + 1)
    parts = [*columns.values(), F.col(y).cast("double")]
    z = [F.lit(1.0)] + [c - F.lit(float(m)) for c, m in zip(parts, centre)]
    names = [f"z{i}" for i in range(len(z))]
    keys = [by] if by else []
    rows = df.select(*keys, F.col(group).alias("_g"), *[c.alias(n) for c, n in zip(z, names)])
    rows = rows.na.drop(subset=[*keys, "_g", *names])
    cells = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    per_group = rows.groupBy(*keys, "_g").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.sum(n).alias(n) for n in names],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"w_{i}_{j}") for i, j in cells],
    )
    return per_group.groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.sum(f"w_{i}_{j}").alias(f"w_{i}_{j}") for i, j in cells],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"b_{i}_{j}") for i, j in cells],
    )


def _matrix(row, letter: str, m: int) -> np.ndarray:
    out = np.empty((m, m))
    for i in range(m):
        for j in range(i, m):
            out[i, j] = out[j, i] = row[f"{letter}_{i}_{j}"]
    return out


# Variance ratios that one job of the search looks at.
POINTS = 256
Part = tuple[np.ndarray, np.ndarray, float, float]


@dataclass
class _Totals:
    within: np.ndarray
    n_obs: float
    n_groups: float
    sizes: tuple[int, float, int]


def _totals(stats: DataFrame, by: str, m: int) -> dict[object, _Totals]:
    """Sums of the sufficient statistics over all group sizes, per stratum."""
    cells = [f"{i}_{j}" for i in range(m) for j in range(i, m)]
    size, groups = F.col("size"), F.col("groups")
    rows = stats.groupBy(by).agg(
        F.sum(size * groups).alias("n_obs"),
        F.sum(groups).alias("n_groups"),
        F.min(size).alias("least"),
        F.max(size).alias("most"),
        *[F.sum(f"w_{c}").alias(f"w_{c}") for c in cells],
    )
    return {
        r[by]: _Totals(
            _matrix(r, "w", m),
            float(r["n_obs"]),
            float(r["n_groups"]),
            (r["least"], r["n_obs"] / r["n_groups"], r["most"]),
        )
        for r in rows.collect()
    }


def _evaluate(
    stats: DataFrame, by: str, m: int, asked: Sequence[tuple[object, float]]
) -> list[Part]:
    """The likelihood's four weighted sums for pairs of stratum and variance ratio, in one job.

    The pairs are broadcast: there are at most POINTS of them for each model.
    """
    cells = [f"{i}_{j}" for i in range(m) for j in range(i, m)]
    kind = stats.schema[by].dataType.simpleString()
    requests = stats.sparkSession.createDataFrame(
        [(k, s, float(t)) for k, (s, t) in enumerate(asked)], f"at int, {by} {kind}, theta double"
    )
    size, groups, theta = F.col("size"), F.col("groups"), F.col("theta")
    grown = 1.0 + size * theta
    sums = stats.join(F.broadcast(requests), by).groupBy("at").agg(
        F.sum(groups * F.ln(grown)).alias("log_v"),
        F.sum(groups * size / grown).alias("slope_v"),
        *[F.sum(theta / grown * F.col(f"b_{c}")).alias(f"k_{c}") for c in cells],
        *[F.sum(F.col(f"b_{c}") / (grown * grown)).alias(f"d_{c}") for c in cells],
    )
    rows = sorted(sums.collect(), key=lambda r: r["at"])
    return [(_matrix(r, "k", m), _matrix(r, "d", m), r["log_v"], r["slope_v"]) for r in rows]


def _curvature(
    stats: DataFrame, by: str, m: int, asked: Sequence[tuple[object, float]]
) -> list[tuple[np.ndarray, float]]:
    """Second derivatives by the variance ratio of the weighted sums of products and of log V, in one job."""
    cells = [f"{i}_{j}" for i in range(m) for j in range(i, m)]
    kind = stats.schema[by].dataType.simpleString()
    requests = stats.sparkSession.createDataFrame(
        [(k, s, float(t)) for k, (s, t) in enumerate(asked)], f"at int, {by} {kind}, theta double"
    )
    size, groups = F.col("size"), F.col("groups")
    grown = 1.0 + size * F.col("theta")
    sums = stats.join(F.broadcast(requests), by).groupBy("at").agg(
        F.sum(-groups * size * size / (grown * grown)).alias("log_v"),
        *[F.sum(2 * size * F.col(f"b_{c}") / (grown * grown * grown)).alias(f"c_{c}") for c in cells],
    )
    return [(_matrix(r, "c", m), r["log_v"]) for r in sorted(sums.collect(), key=lambda r: r["at"])]


def _variance_errors(
    fit: MixedFit, within: np.ndarray, part: Part, curve: tuple[np.ndarray, float], reml: bool
) -> tuple[float | None, float | None]:
    """Standard errors of the variance ratio and of the group variance, from the observed information.

    ``within`` and the parts are those of the fit's design columns and y.  The
    coefficients are profiled out; ratio and scale keep their joint information.
    None where the likelihood isn't at a peak, as at a ratio of 0.
    """
    if fit.ratio <= 0 or not fit.converged:
        return None, None
    p = len(fit.names)
    shrunk, change, _, _ = part
    second, log_v2 = curve
    q = within - shrunk
    a = q[:p, :p]
    v = np.append(-np.linalg.solve(a, q[:p, p]), 1.0)
    # By the ratio, q has the first derivative -change and the second derivative ``second``.
    pull = (change @ v)[:p]
    r1 = -(v @ change @ v)
    r2 = v @ second @ v - 2.0 * pull @ np.linalg.solve(a, pull)
    s2 = fit.scale
    free = fit.n_obs - p if reml else fit.n_obs
    if reml:
        turned = np.linalg.solve(a, change[:p, :p])
        log_v2 = log_v2 + np.trace(np.linalg.solve(a, second[:p, :p])) - np.trace(turned @ turned)
    info = np.array(
        [[0.5 * (log_v2 + r2 / s2), -0.5 * r1 / s2**2], [-0.5 * r1 / s2**2, 0.5 * free / s2**2]]
    )
    if np.linalg.det(info) <= 0 or info[0, 0] <= 0:
        return None, None
    cov = np.linalg.inv(info)
    slope = np.array([s2, fit.ratio])
    return float(math.sqrt(cov[0, 0])), float(math.sqrt(slope @ cov @ slope))


def _maximise(
    names: list[str], sums: _Totals, centre: Sequence[float], reml: bool
) -> Generator[Sequence[float], list[Part], MixedFit]:
    """The fit of one model; asks for the sums at some variance ratios and goes on with them."""
    p = len(names)
    diagonal = np.sqrt(np.diag(sums.within)[:p])
    scaled = sums.within[:p, :p] / np.outer(diagonal, diagonal) if (diagonal > 0).all() else None
    if scaled is None or np.linalg.matrix_rank(scaled, tol=1e-10) < p:
        raise ValueError("the design columns are linearly dependent")
    free = sums.n_obs - p if reml else sums.n_obs

    def solve(theta: float, part: tuple):
        """Log-likelihood, its slope, coefficients, scale and information at one ratio."""
        shrunk, change, log_v, slope_v = part
        q = sums.within - shrunk
        a = q[:p, :p]
        beta = np.linalg.solve(a, q[:p, p])
        v = np.append(-beta, 1.0)
        scale = max(v @ q @ v, 1e-300) / free
        ll = -0.5 * (free * math.log(2 * math.pi * scale) + log_v + free)
        slope = 0.5 * (v @ change @ v) / scale - 0.5 * slope_v
        if reml:
            ll -= 0.5 * np.linalg.slogdet(a)[1]
            slope += 0.5 * np.trace(np.linalg.solve(a, change[:p, :p]))
        return ll, slope, beta, scale, a

    def at(thetas: Sequence[float]):
        parts = yield thetas
        return [solve(t, part) for t, part in zip(thetas, parts)]

    grid = np.concatenate([[0.0], 10.0 ** np.arange(-6, 6.01, 0.125)])
    found = yield from at(grid)
    best = int(np.argmax([f[0] for f in found]))
    low, high = max(best - 1, 0), min(best + 1, len(grid) - 1)
    lo, hi = float(grid[low]), float(grid[high])
    if found[low][1] <= 0:
        hi = lo
    elif found[high][1] >= 0:
        lo = hi
    # The slope changes its sign inside: every job narrows the interval by so many points.
    while hi - lo > 1e-14 * hi:
        points = np.linspace(lo, hi, POINTS + 2)
        if not (np.diff(points) > 0).all():
            break
        inner = yield from at(points[1:-1])
        falling = [f[1] <= 0 for f in inner]
        k = falling.index(True) + 1 if any(falling) else POINTS + 1
        lo, hi = float(points[k - 1]), float(points[k])
    theta = 0.5 * (lo + hi)
    last = yield from at([theta])
    ll, _, beta, scale, a = last[0]
    # Undo the centring: only the intercept changes.
    back = np.eye(p)
    back[0, 1:] = -np.asarray(centre[:-1])
    coef = back @ beta
    coef[0] += centre[-1]
    cov = back @ (scale * np.linalg.inv(a)) @ back.T
    # At the end of the grid the likelihood still rises, and no ratio was found.
    converged = bool(theta < grid[-1])
    return MixedFit(
        names,
        coef,
        cov,
        float(theta * scale),
        float(scale),
        float(ll),
        int(sums.n_obs),
        int(sums.n_groups),
        group_sizes=sums.sizes,
        converged=converged,
    )


def fit_formulas(
    df: DataFrame,
    y: str,
    formulas: Mapping[str, Sequence[str]],
    group: str,
    reml: bool = False,
    by: str | None = None,
    levels: Levels | None = None,
    variance_errors: bool = False,
) -> list[MixedFit]:
    """Fit several formulas on the rows that are complete for all of them, per stratum.

    The rows are read for the levels of categories that are not given, for the
    column means and once for the sufficient statistics of all design columns
    together, which are written: one row per stratum and distinct group size.
    The search over the variance ratio runs on them, all models in one job a
    round, at any number of sizes.  ``variance_errors`` adds the standard errors
    of the variances, in two more such jobs for all models.
    """
    terms = list(dict.fromkeys(t for f in formulas.values() for t in f))
    known = category_levels(df, terms, levels)
    columns = design_columns(df, terms, known)
    every = ["Intercept", *columns]
    parts = [*columns.values(), F.col(y).cast("double")]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(parts)]).first()
    centre = [float(v) if v is not None else 0.0 for v in means]
    source, stratum = (df, by) if by else (df.withColumn("_all", F.lit(0)), "_all")
    stats = cut_lineage(sufficient_statistics(source, y, columns, group, centre, stratum))
    m = len(every) + 1
    totals = _totals(stats, stratum, m)
    own = {f: ["Intercept", *design_columns(df, t, known)] for f, t in formulas.items()}
    place = {f: [*[every.index(n) for n in names], m - 1] for f, names in own.items()}
    fits: dict[tuple, MixedFit] = {}
    searches: dict[tuple, Generator] = {}
    asked: dict[tuple, Sequence[float]] = {}

    def advance(key: tuple, parts: list[Part] | None) -> None:
        try:
            asked[key] = searches[key].send(parts)
        except StopIteration as done:
            asked.pop(key, None)
            fits[key] = done.value

    for s in sorted(totals):
        for f, names in own.items():
            at = place[f]
            sums = totals[s]
            mine = _Totals(sums.within[np.ix_(at, at)], sums.n_obs, sums.n_groups, sums.sizes)
            middle = [centre[i - 1] for i in at[1:]]
            searches[s, f] = _maximise(names, mine, middle, reml)
            advance((s, f), None)
    while asked:
        now = list(asked.items())
        found = iter(_evaluate(stats, stratum, m, [(s, t) for (s, _), ts in now for t in ts]))
        for (s, f), ts in now:
            cut = np.ix_(place[f], place[f])
            advance((s, f), [(k[cut], d[cut], lv, sv) for k, d, lv, sv in (next(found) for _ in ts)])
    if variance_errors:
        pairs = [(key, fit.ratio) for key, fit in fits.items()]
        points = [(s, ratio) for (s, _), ratio in pairs]
        parts, curves = _evaluate(stats, stratum, m, points), _curvature(stats, stratum, m, points)
        for ((s, f), _), (k, d, lv, sv), (c, lv2) in zip(pairs, parts, curves):
            cut = np.ix_(place[f], place[f])
            errors = _variance_errors(
                fits[s, f], totals[s].within[cut], (k[cut], d[cut], lv, sv), (c[cut], lv2), reml
            )
            fits[s, f].ratio_se, fits[s, f].group_var_se = errors
    for (s, f), fit in fits.items():
        fit.stratum, fit.model = (s if by else None), f
        used = {v for t in _expand(formulas[f]) for v in t}
        fit.levels = {n: v for n, v in known.items() if n in used}
    return [fits[s, f] for f in formulas for s in sorted(totals)]


def fit_mixed(
    df: DataFrame,
    y: str,
    terms: Sequence[str],
    group: str,
    reml: bool = False,
    by: str | None = None,
    levels: Levels | None = None,
) -> list[MixedFit]:
    """Fit y on the terms with a random intercept per group, one model per stratum."""
    return fit_formulas(df, y, {"": terms}, group, reml, by, levels)


def coefficients(spark: SparkSession, fits: Sequence[MixedFit], by: str | None = None) -> DataFrame:
    rows = [((str(f.stratum),) if by else ()) + r for f in fits for r in f.coefficient_rows()]
    return spark.createDataFrame(rows, (f"{by} string, " if by else "") + COEF_SCHEMA)


def summaries(spark: SparkSession, fits: Sequence[MixedFit], by: str | None = None) -> DataFrame:
    rows = [
        ((str(f.stratum),) if by else ())
        + (f.n_obs, f.n_groups, f.group_var, f.scale, f.loglik, f.aic)
        for f in fits
    ]
    return spark.createDataFrame(rows, (f"{by} string, " if by else "") + SUMMARY_SCHEMA)


VARIANCE_SCHEMA = (
    "group_var double, group_var_se double, scale double, ratio double, ratio_se double, converged boolean"
)


def variances(
    df: DataFrame,
    y: str,
    terms: Sequence[str],
    group: str,
    reml: bool = False,
    by: str | None = None,
    levels: Levels | None = None,
) -> DataFrame:
    """Group variance, scale and their ratio with standard errors, one row per stratum.

    The errors come from the observed information with the coefficients profiled
    out; they are NULL at a ratio of 0, where the likelihood has no peak.
    """
    fits = fit_formulas(df, y, {"": terms}, group, reml, by, levels, variance_errors=True)
    rows = [
        ((str(f.stratum),) if by else ())
        + (f.group_var, f.group_var_se, f.scale, f.ratio, f.ratio_se, f.converged)
        for f in fits
    ]
    return df.sparkSession.createDataFrame(rows, (f"{by} string, " if by else "") + VARIANCE_SCHEMA)


def mixed_lm(
    df: DataFrame, y: str, terms: Sequence[str], group: str, reml: bool = False
) -> DataFrame:
    """Coefficient table of one model."""
    return coefficients(df.sparkSession, fit_mixed(df, y, terms, group, reml))


def mixed_lm_by(
    df: DataFrame, by: str, y: str, terms: Sequence[str], group: str, reml: bool = False
) -> DataFrame:
    """Coefficient tables per stratum, from one pass over all strata."""
    return coefficients(df.sparkSession, fit_mixed(df, y, terms, group, reml, by), by)


def compare_models(
    df: DataFrame, y: str, formulas: Mapping[str, Sequence[str]], group: str
) -> DataFrame:
    """Maximum-likelihood fits of several formulas with their AIC, on the rows complete for all of them."""
    rows = [
        (f.model, f.n_obs, f.n_groups, f.group_var, f.scale, f.loglik, f.aic)
        for f in fit_formulas(df, y, formulas, group)
    ]
    return df.sparkSession.createDataFrame(rows, "model string, " + SUMMARY_SCHEMA)


def group_report(spark: SparkSession, fits: Sequence[MixedFit]) -> DataFrame:
    """Groups of each model with their least, mean and greatest size, and convergence."""
    rows = [(f.model, str(f.stratum), f.n_groups, *f.group_sizes, f.converged) for f in fits]
    return spark.createDataFrame(
        [(m, s, n, int(lo), float(mean), int(hi), c) for m, s, n, lo, mean, hi, c in rows],
        "model string, stratum string, n_groups bigint, least bigint, mean double, most bigint, converged boolean",
    )


def predict_mixed(
    df: DataFrame, terms: Sequence[str], fit: MixedFit, name: str = "predicted"
) -> DataFrame:
    """Fixed-effect prediction per row, as one column expression.

    Categories have the levels of the fit, on whatever rows; a value that the fit
    hasn't seen gives NULL.
    """
    columns = design_columns(df, terms, fit.levels)
    parts = [F.lit(float(fit.coef[0]))]
    parts += [F.lit(float(b)) * columns[n] for n, b in zip(fit.names[1:], fit.coef[1:])]
    return df.withColumn(name, reduce(lambda a, b: a + b, parts))
