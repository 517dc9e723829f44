"""Textbook values and brute force for the statistical operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import clusters, mixed, shape, survival
from cohortflow.operators.cgm import patient_metrics
from cohortflow.operators.tails import chi2_tail
from cohortflow.operators.wilcoxon import wilcoxon
from cohortflow.plans import bindings as B
from cohortflow.session import cut_lineage

# The 6-MP leukaemia trial (Freireich 1963), weeks, censored ones negative.
DRUG = [6, 6, 6, -6, 7, -9, 10, -10, -11, 13, 16, -17, -19, -20, 22, 23, -25, -32, -32, -34, -35]
PLACEBO = [1, 1, 2, 2, 3, 4, 4, 5, 5, 8, 8, 8, 8, 11, 11, 12, 12, 15, 17, 22, 23]
# Differences of Darwin's maize pairs.
MAIZE = [6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75]


def trial(spark):
    rows = [(float(abs(t)), int(t > 0), arm) for arm, ts in ((1, DRUG), (0, PLACEBO)) for t in ts]
    return spark.createDataFrame(rows, "T double, E int, arm int")


def paired(spark, diffs):
    return spark.createDataFrame([("m", float(d), 0.0) for d in diffs], "variable string, a double, b double")


def test_signed_rank_exact(spark):
    row = wilcoxon(paired(spark, MAIZE), "variable", method="exact").first()
    assert (row["w_plus"], row["w_minus"]) == (96.0, 24.0)
    assert row["exact"] and row["p"] == pytest.approx(0.041259765625, abs=1e-12)
    assert row["z"] == pytest.approx(-2.044663, abs=1e-6)
    normal = wilcoxon(paired(spark, MAIZE), "variable").first()
    assert not normal["exact"]
    assert normal["p"] == pytest.approx(0.040888, abs=1e-6)


def test_signed_rank_ties_and_zero(spark):
    row = wilcoxon(paired(spark, [1, 1, -1, 2, 2, 3, -3, 4, 0, 5]), "variable").first()
    assert (row["n"], row["w_plus"], row["w_minus"], row["exact"]) == (9, 36.5, 8.5, False)
    assert row["z"] == pytest.approx(-1.667376, abs=1e-6)
    assert row["p"] == pytest.approx(0.095440, abs=1e-6)
    assert row["p_text"] == "p = 0.095"
    with pytest.raises(ValueError):
        wilcoxon(paired(spark, [1]), "variable", method="other")


def test_method_does_not_follow_the_size(spark):
    many = [float(i + 1) * (1 if i % 3 else -1) for i in range(60)]
    exact = wilcoxon(paired(spark, many), "variable", method="exact").first()
    normal = wilcoxon(paired(spark, many[:20]), "variable").first()
    assert exact["exact"] and not normal["exact"]
    assert exact["p"] == pytest.approx(wilcoxon(paired(spark, many), "variable").first()["p"], rel=0.05)


def test_signed_rank_all_zero(spark):
    row = wilcoxon(paired(spark, [0, 0, 0]), "variable").first()
    assert (row["n"], row["p"], row["n_pairs"]) == (0, 1.0, 3)


def test_kaplan_meier_pins(spark):
    rows = survival.kaplan_meier(trial(spark)).where("arm = 1").collect()
    s = {r["T"]: r["survival"] for r in rows}
    want = {6: 0.857143, 7: 0.806723, 10: 0.752941, 13: 0.690196, 16: 0.627451, 22: 0.537815, 23: 0.448179}
    for t, v in want.items():
        assert s[t] == pytest.approx(v, abs=1e-6)
    ordered = [s[t] for t in sorted(s)]
    assert all(a >= b for a, b in zip(ordered, ordered[1:]))
    for r in rows:
        assert r["ci_lo"] <= r["survival"] <= r["ci_hi"]


def test_kaplan_meier_reaches_zero(spark):
    last = survival.kaplan_meier(trial(spark)).where("arm = 0").orderBy(F.desc("T")).first()
    assert (last["survival"], last["ci_lo"], last["ci_hi"]) == (0.0, 0.0, 0.0)


def test_logrank_pins(spark):
    row = survival.logrank(trial(spark), 1).first()
    assert row["observed"] == 9
    assert row["expected"] == pytest.approx(19.250501, abs=1e-6)
    assert row["variance"] == pytest.approx(6.256961, abs=1e-6)
    assert row["chi2"] == pytest.approx(16.792941, abs=1e-6)
    assert row["p"] == pytest.approx(4.1688e-05, rel=1e-4)


def test_logrank_with_an_empty_arm(spark):
    row = survival.logrank(trial(spark).where("arm = 0"), 1).first()
    assert row["chi2"] is None and row["p"] is None


@pytest.mark.parametrize(
    "ties, coef, se, ll",
    [("efron", -1.572125, 0.412397, -85.008425), ("breslow", -1.509191, 0.409564, -86.379622)],
)
def test_cox_pins(spark, ties, coef, se, ll):
    row = survival.cox_ph(trial(spark), x=["arm"], ties=ties).first()
    assert row["converged"]
    assert row["coef"] == pytest.approx(coef, abs=1e-6)
    assert row["se"] == pytest.approx(se, abs=1e-6)
    assert row["loglik"] == pytest.approx(ll, abs=1e-6)


def efron(t, e, x, beta):
    """Log-likelihood, gradient and information, event by event."""
    ll, p = 0.0, x.shape[1]
    grad, info = np.zeros(p), np.zeros((p, p))
    r = np.exp(x @ beta)
    for time in np.unique(t[e == 1]):
        risk, dead = t >= time, (t == time) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        grad += x[dead].sum(axis=0)
        for k in range(d):
            w = r * risk - (k / d) * r * dead
            s, sx = w.sum(), x.T @ w
            ll -= math.log(s)
            grad -= sx / s
            info += (x.T * w) @ x / s - np.outer(sx, sx) / s**2
    return ll, grad, info


def test_pieces_follow_the_distinct_times(spark, monkeypatch):
    df = spark.range(200_000).select((F.col("id") / 1000).alias("t")).unionByName(spark.createDataFrame([(0.5,)] * 50 + [(None,)], "t double"))
    got = survival.in_pieces(df, "t").where("t IS NOT NULL").groupBy("_piece").agg(
        F.countDistinct("t").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")
    ).orderBy("_piece").collect()
    assert len(got) > 40 and max(r["n"] for r in got) < 3 * survival.PIECE
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("piece", [1, 7])
@pytest.mark.parametrize("unit", [1e-3, 1.0, 1e6])
def test_small_pieces_give_the_same_curves(spark, monkeypatch, piece, unit):
    whole = {(r["arm"], r["T"]): r.asDict() for r in survival.kaplan_meier(trial(spark)).collect()}
    monkeypatch.setattr(survival, "PIECE", piece)
    scaled = trial(spark).withColumn("T", F.col("T") * unit)
    for r in survival.kaplan_meier(scaled).collect():
        want = whole[r["arm"], round(r["T"] / unit)]
        assert {k: v for k, v in r.asDict().items() if k != "T"} == pytest.approx({k: v for k, v in want.items() if k != "T"})
    assert survival.logrank(scaled, 1).first()["chi2"] == pytest.approx(16.792941, abs=1e-6)
    assert survival.cox_ph(scaled).first()["coef"] == pytest.approx(-1.572125, abs=1e-6)


@pytest.mark.parametrize("piece", [1, 4096])
def test_cox_step_with_many_ties(spark, monkeypatch, piece):
    monkeypatch.setattr(survival, "PIECE", piece)
    rng = np.random.default_rng(5)
    n = 300
    t = rng.integers(1, 5, n).astype(float)
    e = (rng.random(n) < 0.7).astype(int)
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n).round(2)])
    beta = np.array([0.3, -0.4])
    rows = [(float(a), int(b), float(c), float(d), 1) for a, b, (c, d) in zip(t, e, x)]
    df = spark.createDataFrame(rows, "t double, e int, x0 double, x1 double, m bigint")
    got = survival._cox_step(survival.in_pieces(df, "t"), beta, "efron")
    want = efron(t, e, x, beta)
    assert got[0] == pytest.approx(want[0], rel=1e-10)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(got[2], want[2], rtol=1e-8, atol=1e-8)


def grouped(spark):
    rows = [(g, v) for g, vs in enumerate([(1, 2, 3), (4, 5, 9), (2, 2, 5), (7, 8, 6)]) for v in vs]
    return spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, y double")


def test_random_intercept_pins(spark):
    ml = mixed.fit_mixed(grouped(spark), "y", [], "g")[0]
    assert ml.coef[0] == pytest.approx(4.5)
    assert ml.scale == pytest.approx(3.0, abs=1e-9)
    assert ml.group_var == pytest.approx(3.25, abs=1e-9)
    assert ml.loglik == pytest.approx(-26.512774, abs=1e-6)
    assert ml.aic == pytest.approx(59.025548, abs=1e-6)
    reml = mixed.fit_mixed(grouped(spark), "y", [], "g", reml=True)[0]
    assert reml.group_var == pytest.approx(4.666667, abs=1e-6)


def likelihood(theta, x, y, g, reml):
    n, p = x.shape
    v = np.eye(n) + theta * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    res = y - x @ beta
    free = n - p if reml else n
    scale = res @ vi @ res / free
    ll = -0.5 * (free * math.log(2 * math.pi * scale) + np.linalg.slogdet(v)[1] + free)
    return (ll - 0.5 * np.linalg.slogdet(a)[1] if reml else ll), beta, scale, np.linalg.inv(a) * scale


@pytest.mark.parametrize("reml", [False, True])
def test_mixed_model_against_dense_matrices(spark, reml):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):
        shift = rng.normal(scale=1.5)
        for week in range(rng.integers(1, 7)):
            arm = "with" if g % 2 else "none"
            y = 30 - 0.2 * week + (0.5 - 0.1 * week) * (g % 2) + shift + rng.normal()
            rows.append((g, week, arm, float(25 + g % 5), float(y)))
    df = spark.createDataFrame(rows, "g int, week int, arm string, base double, y double")
    fit = mixed.fit_mixed(df, "y", ["week*arm", "base"], "g", reml=reml)[0]
    assert fit.names == ["Intercept", "week", "arm=with", "base", "week:arm=with"]
    a = np.array([r[2] == "with" for r in rows], float)
    w = np.array([r[1] for r in rows], float)
    x = np.column_stack([np.ones(len(rows)), w, a, [r[3] for r in rows], w * a])
    y = np.array([r[4] for r in rows])
    g = np.array([r[0] for r in rows])
    theta = fit.group_var / fit.scale
    ll, beta, scale, cov = likelihood(theta, x, y, g, reml)
    assert fit.loglik == pytest.approx(ll, abs=1e-7)
    np.testing.assert_allclose(fit.coef, beta, rtol=1e-7)
    np.testing.assert_allclose(fit.cov, cov, rtol=1e-6, atol=1e-9)
    assert fit.scale == pytest.approx(scale, rel=1e-8)
    for other in (theta * 0.98, theta * 1.02):
        assert likelihood(other, x, y, g, reml)[0] < ll


@pytest.mark.parametrize("reml", [False, True])
def test_strata_and_formulas_fit_as_alone(spark, monkeypatch, reml):
    rows = [(i % 17, i % 5, float(20 + (i % 17) ** 1.5 - 0.3 * (i % 5) + (i * 7 % 11) / 5), i % 2 == 0)
            for i in range(150) if i % 17 < 5 + i % 12]
    df = spark.createDataFrame(rows, "g int, week int, y double, drug boolean").cache()
    here = [mixed.fit_mixed(df.where(F.col("drug") == s), "y", ["week"], "g", reml=reml)[0] for s in (False, True)]
    there = mixed.fit_mixed(df, "y", ["week"], "g", reml=reml, by="drug")
    assert [f.stratum for f in there] == [False, True]
    formulas = {"one": ["week"], "two": ["week*drug"], "none": []}
    there += mixed.fit_formulas(df, "y", formulas, "g", reml=reml)
    here += [mixed.fit_mixed(df, "y", t, "g", reml=reml)[0] for t in formulas.values()]
    monkeypatch.setattr(mixed, "POINTS", 16)
    there += mixed.fit_mixed(df, "y", ["week"], "g", reml=reml)
    here.append(here[2])
    for a, b in zip(here, there, strict=True):
        np.testing.assert_allclose(a.coef, b.coef, rtol=1e-9)
        np.testing.assert_allclose(a.cov, b.cov, rtol=1e-8)
        assert a.loglik == pytest.approx(b.loglik, abs=1e-9)
        assert a.group_var == pytest.approx(b.group_var, rel=1e-8)
        assert (a.n_obs, a.n_groups) == (b.n_obs, b.n_groups)


def test_prediction_has_the_levels_of_the_fit(spark):
    rows = [(i % 30, "ABCDE"[i % 5], float(i % 7), float(i % 5 + (i * 7 % 11) / 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, seg string, x double, y double")
    fit = mixed.fit_mixed(df, "y", ["x", "seg"], "g")[0]
    assert fit.levels == {"seg": list("ABCDE")} and len(fit.names) == 6
    coef = dict(zip(fit.names, fit.coef))
    new = spark.createDataFrame([("B", 1.0), ("D", 2.0), ("Z", 1.0), (None, 1.0)], "seg string, x double")
    got = [r["predicted"] for r in mixed.predict_mixed(new, ["x", "seg"], fit).collect()]
    want = [coef["Intercept"] + coef["x"] * x + coef[f"seg={s}"] for s, x in (("B", 1.0), ("D", 2.0))]
    assert got[:2] == pytest.approx(want) and got[2:] == [None, None]
    only = mixed.predict_mixed(new.where("seg = 'B'"), ["x", "seg"], fit).first()["predicted"]
    assert only == pytest.approx(want[0])
    other = mixed.fit_mixed(df, "y", ["x", "seg"], "g", levels={"seg": list("EABCD")})[0]
    assert "seg=A" in other.names and other.loglik == pytest.approx(fit.loglik)
    report = mixed.group_report(spark, [fit]).first()
    assert (report["n_groups"], report["least"], report["most"], report["converged"]) == (30, 6, 7, True)


def test_many_levels(spark):
    rows = [(i, f"L{i % 250:03d}", float(i % 13)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, lev string, y double")
    assert len(mixed.design_columns(df, ["lev"])) == 249


def test_no_group_variance_gives_least_squares(spark):
    rows = [(i % 3, float(i), float(2 * i + (-1) ** i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    fit = mixed.fit_mixed(df, "y", ["x"], "g")[0]
    x = np.column_stack([np.ones(12), [r[1] for r in rows]])
    beta = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]
    assert fit.group_var == pytest.approx(0.0, abs=1e-9)
    np.testing.assert_allclose(fit.coef, beta, rtol=1e-8)


def test_dependent_columns_are_refused(spark):
    df = grouped(spark).withColumn("x", F.lit(1.0))
    with pytest.raises(ValueError):
        mixed.fit_mixed(df, "y", ["x"], "g")


def test_reference_level_is_the_lowest(spark):
    df = spark.createDataFrame([("有", 1.0), ("无", 2.0)], "c string, y double")
    assert list(mixed.design_columns(df, ["c"])) == ["c=有"]


def test_clusters_separate_and_repeat(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        x, y = np.array([(0, 0), (8, 0), (0, 8)][i % 3]) + rng.normal(size=2)
        rows.append((i, float(x), float(y)))
    rows.append((90, None, 1.0))
    df = spark.createDataFrame(rows, "patient_id int, a double, b double")
    model = clusters.fit_clusters(df, ["a", "b"], k=3, seed=7)
    got = {r["patient_id"]: r["cluster"] for r in clusters.assign_clusters(model, df, df.select("patient_id")).collect()}
    assert got[90] is None
    groups = [{got[i] for i in range(k, 90, 3)} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    again = clusters.fit_clusters(df, ["a", "b"], k=3, seed=7)
    assert {r["patient_id"]: r["cluster"] for r in clusters.score(again, df).collect()} == {
        k: v for k, v in got.items() if v is not None
    }
    report = clusters.fit_report(model)
    assert report["converged"] and report["rounds"] < 100
    assert not clusters.fit_report(clusters.fit_clusters(df, ["a", "b"], max_iter=1))["converged"]
    profile = clusters.cluster_profile(model, df).collect()
    assert sum(r["n"] for r in profile) == 90
    assert sum(r["n"] * r["a"] for r in profile) == pytest.approx(0.0, abs=1e-9)


def test_projection_matches_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "patient_id int, a double, b double, c double")
    model = clusters.fit_clusters(df, ["a", "b", "c"], k=2)
    got = {r["patient_id"]: (r["pc1"], r["pc2"]) for r in clusters.project2d(model, df).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    v = np.linalg.svd(z)[2][:2].T
    v *= np.where(v[np.abs(v).argmax(axis=0), [0, 1]] > 0, 1, -1)
    np.testing.assert_allclose([got[i] for i in range(60)], z @ v, atol=1e-8)


# Concordance, likelihood ratio, errors of variances, resampled bands.


def brute_pairs(t, e, s):
    concordant = tied = comparable = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                comparable += 1
                concordant += s[i] > s[j]
                tied += s[i] == s[j]
    return concordant, tied, comparable


@pytest.mark.parametrize("piece", [1, 4096])
@pytest.mark.parametrize("times", [6, 10_000])
def test_concordance_equals_all_pairs(spark, monkeypatch, piece, times):
    monkeypatch.setattr(survival, "PIECE", piece)
    rng = np.random.default_rng(times)
    n = 260
    t, e = rng.integers(1, times, n).astype(float), (rng.random(n) < 0.6).astype(int)
    s = np.where(rng.random(n) < 0.4, rng.integers(0, 3, n), rng.normal(size=n))
    rows = [(float(a), int(b), float(c)) for a, b, c in zip(t, e, s)]
    rows += [(None, 1, 0.0), (1.0, None, 0.0), (1.0, 1, None)]
    df = spark.createDataFrame(rows, "T double, E int, score double").repartition(3)
    row = survival.concordance(df).first()
    want = brute_pairs(t, e, s)
    assert tuple(int(row[c]) for c in ("concordant", "tied", "comparable")) == want
    assert row["concordance"] == pytest.approx((want[0] + want[1] / 2) / want[2])
    twice = survival.concordance(df.withColumn("w", F.lit(2)), weight="w").first()
    assert int(twice["comparable"]) == 4 * want[2] and int(twice["tied"]) == 4 * want[1]


def test_concordance_without_pairs(spark):
    df = spark.createDataFrame([(1.0, 1, 0.5), (1.0, 1, 0.7), (0.5, 0, 2.0)], "T double, E int, score double")
    assert [tuple(r) for r in survival.concordance(df).collect()] == [(0, 0, 0, None)]
    assert survival.concordance(df.limit(0)).first()["comparable"] == 0


@pytest.mark.parametrize(
    ("x", "df", "want"),
    [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
     (18.307038053275146, 10, 0.05), (0.0, 2, 1.0), (26.757, 11, 0.005), (0.1, 9, 0.9999999764)],
)
def test_chi_square_tail(x, df, want):
    assert chi2_tail(x, df) == pytest.approx(want, rel=1e-4)


def test_cox_summary_of_the_trial(spark):
    row = survival.cox_summary(trial(spark), x=["arm"]).first()
    data = [(r["T"], r["E"], r["arm"]) for r in trial(spark).collect()]
    t, e, arm = (np.array(c, float) for c in zip(*data))
    null = efron(t, e, arm[:, None], np.zeros(1))[0]
    assert row["loglik"] == pytest.approx(-85.008425, abs=1e-6)
    assert row["loglik_null"] == pytest.approx(null, abs=1e-9)
    assert row["chi2"] == pytest.approx(2 * (row["loglik"] - null)) and row["df"] == 1
    assert row["p"] == pytest.approx(math.erfc(math.sqrt(row["chi2"] / 2)))
    assert row["partial_aic"] == pytest.approx(2 - 2 * row["loglik"])
    want = brute_pairs(t, e, -arm)  # the arm of the lower hazard has code 1
    assert (int(row["concordant"]), int(row["tied"]), int(row["comparable"])) == want
    assert (row["n"], row["events"]) == (42, 30)


@pytest.mark.parametrize("reml", [False, True])
def test_errors_of_the_variances(spark, reml):
    """Against numeric second derivatives of the likelihood with whole covariance matrices."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(40):
        shift = rng.normal() * 1.5
        for k in range(rng.integers(2, 7)):
            rows.append((g, float(k), 1.0 + 0.5 * k + shift + rng.normal()))
    df = spark.createDataFrame(rows, "g int, x double, y double")
    row = mixed.variances(df, "y", ["x"], "g", reml=reml).first()
    groups = [np.array([r[1:] for r in rows if r[0] == g]) for g in range(40)]

    def loglik(ratio, scale):
        a, b, rss, logdet, n = np.zeros((2, 2)), np.zeros(2), 0.0, 0.0, 0
        parts = []
        for m in groups:
            x = np.column_stack([np.ones(len(m)), m[:, 0]])
            v = np.eye(len(m)) + ratio * np.ones((len(m), len(m)))
            inv = np.linalg.inv(v)
            a, b = a + x.T @ inv @ x, b + x.T @ inv @ m[:, 1]
            logdet += np.linalg.slogdet(v)[1]
            n += len(m)
            parts.append((x, m[:, 1], inv))
        beta = np.linalg.solve(a, b)
        for x, y, inv in parts:
            rss += (y - x @ beta) @ inv @ (y - x @ beta)
        free = n - 2 if reml else n
        extra = np.linalg.slogdet(a)[1] if reml else 0.0
        return -0.5 * (free * math.log(scale) + logdet + rss / scale + extra)

    at = np.array([row["ratio"], row["scale"]])
    h = at * 1e-3
    info = np.empty((2, 2))
    for i in range(2):
        for j in range(2):
            d, f = np.eye(2)[i] * h, np.eye(2)[j] * h
            second = loglik(*(at + d + f)) - loglik(*(at + d - f)) - loglik(*(at - d + f)) + loglik(*(at - d - f))
            info[i, j] = -second / (4 * h[i] * h[j])
    cov = np.linalg.inv(info)
    slope = np.array([row["scale"], row["ratio"]])
    assert row["ratio_se"] == pytest.approx(math.sqrt(cov[0, 0]), rel=1e-4)
    assert row["group_var_se"] == pytest.approx(math.sqrt(slope @ cov @ slope), rel=1e-4)


def test_no_error_at_a_ratio_of_zero(spark):
    rows = [(g, float(v)) for g in range(20) for v in (1, -1)]
    row = mixed.variances(spark.createDataFrame(rows, "g int, y double"), "y", [], "g").first()
    assert row["ratio"] == 0 and row["ratio_se"] is None and row["group_var_se"] is None


def test_levels_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(mixed, "MOST_LEVELS", 3)
    df = spark.createDataFrame([(str(i),) for i in range(5)], "site string")
    with pytest.raises(ValueError, match="site"):
        mixed.category_levels(df, ["site"])
    assert mixed.category_levels(df.where("site < '3'"), ["site"]) == {"site": ["0", "1", "2"]}


def measured(spark, n=600):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, str(i % 3), float(x)) for i, x in enumerate(rng.normal(5, 2, n))]
    return spark.createDataFrame([*rows, (n, 0, "0", None), (n + 1, None, "0", 1.0)], "id int, week int, arm string, y double")


def test_bands_by_brute_force(spark):
    df = measured(spark)
    got = {(r["week"], r["arm"]): r for r in shape.trajectory_bands(df, "week", ["arm"], "y", ["id"], 50).collect()}
    draw = shape.hashed_draw(["id"])
    drawn = df.na.drop().select("*", *[draw(F.lit(r)).alias(f"u{r}") for r in range(1, 51)]).collect()
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    assert len(got) == 6
    for (week, arm), row in got.items():
        mine = [r for r in drawn if (r["week"], r["arm"]) == (week, arm)]
        y = np.array([r["y"] for r in mine])
        weights = np.array([[np.searchsorted(steps, r[f"u{k}"], side="right") for k in range(1, 51)] for r in mine])
        means = (weights * y[:, None]).sum(axis=0) / weights.sum(axis=0)
        assert (row["n"], row["mean"]) == (len(mine), pytest.approx(y.mean()))
        assert (row["ci_lo"], row["ci_hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
        # Weights of mean and variance 1, another for each row and replicate.
        assert weights.mean() == pytest.approx(1, abs=0.06) and weights.var() == pytest.approx(1, abs=0.12)


def test_bands_don_t_depend_on_layout_and_near_the_normal_interval(spark):
    df = measured(spark, 3000).where("week = 0")
    one = shape.trajectory_bands(df.repartition(1), "week", [], "y", ["id"]).first()
    other = shape.trajectory_bands(df.repartition(9, "y"), "week", [], "y", ["id"]).first()
    assert tuple(one) == pytest.approx(tuple(other), rel=1e-12)
    normal = shape.trajectory(df, "week", [], "y").first()
    width = normal["ci_hi"] - normal["ci_lo"]
    assert one["ci_lo"] == pytest.approx(normal["ci_lo"], abs=0.15 * width)
    assert one["ci_hi"] == pytest.approx(normal["ci_hi"], abs=0.15 * width)


def test_bands_draw_once_a_row_in_many_tasks(spark):
    """Rows of a few bytes become many: they are dealt out first, and a draw is not made anew for each step of its use."""
    df = shape.trajectory_bands(measured(spark).coalesce(1), "week", ["arm"], "y", ["id"], 50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(") == 1
    assert "REPARTITION_BY_NUM" in plan.partition("Generate explode")[2]


def test_bands_leave_out_resamples_without_rows(spark):
    one = spark.createDataFrame([(1, 0, 7.0), (2, 1, float("inf"))], "id int, week int, y double")
    got = {r["week"]: r for r in shape.trajectory_bands(one, "week", [], "y", ["id"], 60).collect()}
    assert tuple(got[0]) == (0, 1, 7.0, 7.0, 7.0)
    assert tuple(got[1])[1:3] == (1, float("inf"))


def test_plain_centres_assign_as_the_model(spark, base):
    df = cut_lineage(patient_metrics(B.readings(spark, base)))
    model = clusters.fit_clusters(df)
    plain = clusters.Centres.of(model)
    want = {r["patient_id"]: r["cluster"] for r in clusters.score(model, df).collect()}
    assert {r["patient_id"]: r["cluster"] for r in plain.assign(df).collect()} == want
    profile = {r["cluster"]: r for r in clusters.cluster_profile(model, df).collect()}
    for r in clusters.profile_of(plain.assign(df), plain.features).collect():
        assert r.asDict() == pytest.approx(profile[r["cluster"]].asDict(), abs=1e-9)
    assert tuple(clusters.at_rest(model, df).first())[1:] == (3, 0, 0)
    moved = clusters.Centres(plain.features, plain.means, plain.sds, plain.centres[::-1])
    assert {r["patient_id"]: 2 - r["cluster"] for r in moved.assign(df).collect()} == want
