"""Results must not depend on layout, and hot keys must stay spread out."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import cgm, ordered, quality, quantiles, windows
from cohortflow.operators import joins as J
from cohortflow.operators.shape import QUARTILES
from cohortflow.plans import bindings as B
from cohortflow.session import scratch_dir
from cohortflow.sources import tables as T


@pytest.fixture(scope="module")
def hot(spark):
    """One patient holds a third of the readings, in an order of its own."""
    rng = np.random.default_rng(8)
    n = 1500
    patient = np.where(rng.random(n) < 0.34, 1, rng.integers(2, 40, n))
    minute = rng.permutation(n * 3)[:n]
    glucose = (5 + 3 * rng.random(n)).round(1)
    rows = [(int(p), int(m), i, float(g)) for i, (p, m, g) in enumerate(zip(patient, minute, glucose))]
    df = spark.createDataFrame(rows, "patient_id int, minute int, reading_id int, glucose double")
    return df.withColumn("ts", F.timestamp_seconds(1_704_067_200 + 60 * F.col("minute"))).cache()


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_running_totals_across_chunks(spark):
    rows = [("a", i, float(i % 7)) for i in range(500)] + [("b", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(5)
    chunk = F.floor(F.col("o") / 10).cast("bigint")
    up = table(ordered.running_totals(df, ["k"], "o", {"t": "v"}, chunk), "k", "o")
    down = table(ordered.running_totals(df, ["k"], "o", {"t": "v"}, chunk, descending=True), "k", "o")
    v = np.array([float(i % 7) for i in range(500)])
    assert [up["a", i]["t"] for i in range(500)] == list(np.cumsum(v))
    assert [down["a", i]["t"] for i in range(500)] == list(np.cumsum(v[::-1])[::-1])
    assert up["b", 2]["t"] == 3.0
    one = table(ordered.running_totals(df.where("k = 'a'"), [], "o", {"t": "v"}, chunk), "o")
    assert one[(499,)]["t"] == v.sum()


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e9])
def test_exact_quantiles(spark, scale):
    rng = np.random.default_rng(6)
    groups = {"big": rng.normal(size=997) * scale, "one": np.array([3.0]), "flat": np.zeros(8),
              "mixed": np.array([-2.0, -1.0, 0.0, 0.0, 5.0]) * scale}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("big", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = {"p0": 0.0, "p05": 0.05, "q1": 0.25, "median": 0.5, "p95": 0.95, "p1": 1.0}
    got = table(quantiles.exact_quantiles(df, ["k"], "v", probs), "k")
    assert set(got) == {(k,) for k in groups}
    for k, v in groups.items():
        assert got[k,]["n"] == len(v)
        for name, p in probs.items():
            assert got[k,][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-15)
    whole = quantiles.exact_quantiles(df.where("k = 'big'"), [], "v", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(np.median(groups["big"]))


def brute_box(v):
    q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    reach = (q3 - q1) * 1.5
    near = v[(v >= q1 - reach) & (v <= q3 + reach)]
    return [q1, median, q3, near.min(), near.max()]


@pytest.mark.parametrize("sketch", [64, 8192])
def test_brackets_keep_few_values(spark, sketch):
    """Groups of far more values than a bracket takes whole; ties, outliers and a hot group."""
    rng = np.random.default_rng(11)
    groups = {
        "hot": rng.normal(size=60_000),
        "ties": rng.integers(0, 12, 20_000).astype(float),
        "tails": np.concatenate([rng.normal(size=20_000), rng.normal(size=300) * 1e6]),
        "flat": np.full(5_000, 2.5),
        "few": np.array([1.0, 2.0, 4.0, 100.0]),
    }
    frame = {"k": np.repeat(list(groups), [len(v) for v in groups.values()]), "v": np.concatenate(list(groups.values()))}
    order = rng.permutation(len(frame["k"]))
    data = [(str(k), float(x)) for k, x in zip(frame["k"][order], frame["v"][order])]
    data += [("few", None), ("few", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    out = quantiles.exact_quantiles(
        df, ["k"], "v", QUARTILES, also={"total": F.count("v"), "top": F.max("v")}, whiskers=True, sketch=sketch
    )
    got = table(out, "k")
    assert set(got) == {(k,) for k in groups}
    for k, v in groups.items():
        row = got[k,]
        assert (row["n"], row["total"], row["top"]) == (len(v), len(v), v.max())
        names = ("q1", "median", "q3", "whisker_lo", "whisker_hi")
        assert [row[c] for c in names] == pytest.approx(brute_box(v), rel=1e-12, abs=1e-12)
    one = quantiles.exact_quantiles(df.where("k = 'hot'"), [], "v", {"m": 0.5, "p": 0.999}, sketch=sketch).collect()
    assert [(r["m"], r["p"]) for r in one] == [tuple(np.quantile(groups["hot"], [0.5, 0.999]))]
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []
    assert quantiles.exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []


def test_rows_between_brackets_are_counted_only(spark):
    """What is put in order is a small share of the rows."""
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.rand(3).alias("v"))
    out = quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") <= 2 and "BroadcastHashJoin" in final


def test_value_bands_keep_order(spark):
    v = [-1e300, -5.0, -4.99, -1e-300, 0.0, 1e-300, 0.1, 0.1001, 7.0, 1e300]
    df = spark.createDataFrame([(x,) for x in v], "v double").select(ordered.value_band("v").alias("b"))
    bands = [r["b"] for r in df.collect()]
    assert bands == sorted(bands)


def test_ranks_of_a_hot_patient(hot):
    got = table(windows.seq_ranks(hot, ["patient_id"], "ts", ordered.time_chunk("ts")), "reading_id")
    want = table(windows.seq_ranks(hot, ["patient_id"], "ts"), "reading_id")
    assert {k: (r["seq_asc"], r["seq_desc"]) for k, r in got.items()} == {
        k: (r["seq_asc"], r["seq_desc"]) for k, r in want.items()
    }


def brute_swings(g):
    steps = [b - a for a, b in zip(g, g[1:]) if b != a]
    runs = []
    for s in steps:
        if runs and (runs[-1] > 0) == (s > 0):
            runs[-1] += s
        else:
            runs.append(s)
    return [abs(x) for x in runs]


@pytest.mark.parametrize("chunk", [120, 3600, 10**7])
def test_excursions_of_a_hot_patient(hot, chunk):
    got = table(cgm.patient_metrics(hot, chunk_seconds=chunk), "patient_id")
    rows = sorted((r["patient_id"], r["ts"], r["reading_id"], r["glucose"]) for r in hot.collect())
    for (p,), row in got.items():
        mine = [r for r in rows if r[0] == p]
        g = [r[3] for r in mine]
        swings = brute_swings(g)
        sd = np.std(g, ddof=1)
        large = [s for s in swings if s > sd]
        hours = (mine[-1][1] - mine[0][1]).total_seconds() / 3600
        assert row["MAG"] == pytest.approx(sum(swings) / hours)
        assert row["MAGE"] == pytest.approx(np.mean(large)) if large else row["MAGE"] is None
        assert row["sd"] == pytest.approx(sd)


def test_layout_does_not_change_results(spark, base):
    r = B.readings(spark, base)
    shuffled = r.orderBy(F.xxhash64("reading_id", F.lit(3))).repartition(7)
    one = table(cgm.weekly_rollup(cgm.daily_summary(r)), "patient_id", "week")
    two = table(cgm.weekly_rollup(cgm.daily_summary(shuffled)), "patient_id", "week")
    assert one.keys() == two.keys()
    for k in one:
        assert one[k].asDict() == pytest.approx(two[k].asDict())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, base):
    df = T.load(spark, base, "orders", ["o_orderkey"], F.col("o_totalprice") > 1000)
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", text)


def test_cohort_extract_prunes_by_time_in_the_scan(spark, base):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-06"))
    cohort = T.load(spark, base, "customer", [F.col("c_custkey").alias("user_id")])
    df = T.cohort_extract(T.load(spark, base, "events"), cohort, "user_id", "ts", start, end, ["value"])
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts,[^]]*LessThanOrEqual\(ts,", plan(df))


def test_first_row_is_cut_before_the_shuffle(spark, base):
    text = plan(windows.keep_one(B.scale(spark, base), ["patient_id"], ["ts", "reading_id"]))
    assert text.count("WindowGroupLimit") == 2
    assert "Partial" in text


def test_no_cross_join_and_no_python_in_the_core(spark, base):
    frames = [
        cgm.weekly_rollup(B.daily(spark, base), min_valid=10),
        cgm.patient_metrics(B.readings(spark, base)),
        cgm.agp(B.readings(spark, base)),
        quality.consistent_exposure(B.orders_f(spark, base), "patient_id", "exposed"),
        J.net_orders(B.orders_f(spark, base), B.refunds(spark, base)),
        J.key_outer(B.snap_old(spark, base), B.snap_new(spark, base), "id"),
    ]
    for df in frames:
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "Python" not in text and "Pandas" not in text


def test_readings_are_shuffled_once_for_the_weekly_rollup(spark, base):
    text = plan(cgm.weekly_rollup(B.daily(spark, base), min_valid=10))
    assert text.count("FileScan") == 1
    # Day rows by patient-day, then all weekly work on one layout by patient.
    assert text.count("Exchange hashpartitioning") == 2


def test_scratch_folder_is_the_named_one(spark):
    path = scratch_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or path == named
    assert spark.sparkContext.getCheckpointDir()


def test_scratch_folder_must_be_named_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        scratch_dir(Session())
