"""Hand-worked cases for the rules on nulls, ties, bins, tails and quirks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import columns as C
from cohortflow.functions import scalars as S
from cohortflow.operators import cgm, joins, quality, revision, shape, survival, windows
from cohortflow.plans import jobs
from cohortflow.session import clear_scratch, scratch_path
from cohortflow.sources import tables


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_elapsed_days_round_down(spark):
    rows = [
        (ts("2024-01-02T23:00:00"), ts("2024-01-02T01:00:00"), -1),
        (ts("2024-01-01T23:00:00"), ts("2024-01-02T01:00:00"), 0),
        (ts("2024-01-01T00:00:00"), ts("2024-01-08T00:00:00"), 7),
    ]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp, want int")
    got = df.select(S.elapsed_days("a", "b").alias("d"), "want")
    assert all(d == w for d, w in values(got, "d", "want"))


def test_week_index_of_negative_days(spark):
    df = spark.createDataFrame([(-8,), (-7,), (-1,), (0,), (6,), (7,)], "d int")
    assert values(df.select(S.week_index("d").alias("w")), "w") == [-2, -1, -1, 0, 0, 1]


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 8, 9, 12, 13, -1)], "v int")
    want = ["<=2", "<=2", "<=2", "3-4", "3-4", "5-8", "9-12", "9-12", ">=13", None]
    assert values(df.select(C.bin_label("v").alias("b")), "b") == want


def test_flag_either_modes(spark):
    df = spark.createDataFrame([("plain", "with token"), (None, "token"), (None, None)], "a string, b string")
    first = df.select(C.flag_either("a", "b", "token", "first").alias("f"))
    both = df.select(C.flag_either("a", "b", "token").alias("f"))
    assert values(first, "f") == [False, True, None]
    assert values(both, "f") == [True, True, False]
    with pytest.raises(ValueError):
        C.flag_either("a", "b", "t", "other")


def test_anti_join_ignores_a_null_in_the_list(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    assert values(joins.anti(df, keys, "k"), "k") == [2]


def test_groups_leave_null_keys_out(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert values(shape.grouped(df, ["k"], n=F.count("v")), "k", "n") == [("a", 1)]


def test_rates_without_rows_or_denominator(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int")
    assert values(shape.global_rate(df, "a", "b"), "rate") == [None]
    assert values(shape.global_rate(df.where("a > 0"), "a", "b"), "rate") == [None]


def test_map_text_with_missing_values(spark):
    rows = [
        ("{'00:01:00': 5.5, '00:02:00': None}",),
        ('{"00:01:00": 0.5, "00:02:00": null}',),
        ("{'00:01:00': nan}",),
        ("no map",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "t string").select(S.parse_day_map("t").alias("m"))
    got = values(df, "m")
    assert got[0] == {"00:01:00": 5.5, "00:02:00": None}
    assert got[1] == {"00:01:00": 0.5, "00:02:00": None}
    assert got[2] == {"00:01:00": None}
    assert got[4] is None
    assert values(df.select(S.count_below("m").alias("n")), "n") == [0, 1, 0, 0, 0]


def maps(spark, *rows):
    return spark.createDataFrame(rows, "id string, old_map map<string,double>, new_map map<string,double>")


def keyed(n, start=0, value=5.0):
    return {f"00:{i:02d}:00": value for i in range(start, start + n)}


def test_diff_tail_counts_above_three_only(spark):
    old = keyed(5)
    df = maps(spark, ("a", old, keyed(8)), ("b", old, keyed(9)))
    got = {r["id"]: r for r in revision.map_diff(df).collect()}
    assert (got["a"]["key_delay"], got["a"]["changed"]) == (0, False)
    assert (got["b"]["key_delay"], got["b"]["changed"]) == (4, True)
    assert got["b"]["key_changed_cnt"] == 4


def test_diff_quirk_drops_key_counts_with_a_short_tail(spark):
    old = {"00:00:00": 1.0, "00:09:00": 1.0}
    new = {**old, "00:01:00": 1.0, "00:02:00": 1.0, **keyed(3, 10)}
    df = maps(spark, ("a", old, new))
    sane = revision.map_diff(df).first()
    strict = revision.map_diff(df, strict_reference=True).first()
    assert (sane["key_changed_cnt"], sane["changed"]) == (2, True)
    assert (strict["key_changed_cnt"], strict["changed"]) == (0, True)
    assert sane["key_added"] == ["00:01:00", "00:02:00"]


def test_diff_without_two_maps(spark):
    df = maps(
        spark, ("none", None, {"a": 1.0}), ("both", None, None), ("gone", {"a": 1.0}, None),
        ("empty", {}, {"a": 1.0}), ("lost", {"a": 1.0, "b": 2.0}, {}),
    )
    got = {r["id"]: r for r in revision.map_diff(df).collect()}
    assert (got["none"]["key_changed_cnt"], got["none"]["changed"]) == (0, True)
    assert got["both"]["changed"] is False
    assert got["gone"]["changed"] is True
    assert (got["empty"]["key_changed_cnt"], got["empty"]["changed"]) == (0, True)
    assert got["lost"]["key_missing"] == ["a", "b"]


def test_diff_of_equal_maps_is_empty(spark):
    m = {"a": 1.0, "b": None, "c": 2.25}
    row = revision.map_diff(maps(spark, ("x", m, m))).first()
    assert not row["changed"] and row["value_changed_cnt"] == 0 and row["key_changed_cnt"] == 0


def test_diff_compares_after_rounding(spark):
    df = maps(spark, ("x", {"a": 5.01, "b": 5.0}, {"a": 5.04, "b": 5.1}))
    row = revision.map_diff(df).first()
    assert [(v["time"], v["old_value"], v["new_value"]) for v in row["value_changed"]] == [("b", 5.0, 5.1)]


def test_long_diff_status_and_delta(spark):
    df = maps(spark, ("x", {"a": 5.0, "b": 6.0, "d": None}, {"a": 5.5, "c": 1.0, "z": 2.0}))
    got = {r["time"]: r for r in revision.map_diff_long(df, before_local_end=False).collect()}
    assert got["a"]["key_status"] == "both" and got["a"]["value_delta"] == 0.5
    assert got["b"]["key_status"] == "only_old" and got["c"]["key_status"] == "only_new"
    kept = {r["time"] for r in revision.map_diff_long(df).collect()}
    assert kept == {"a", "b", "c", "d"}


def test_snapshot_delta_of_a_lost_record(spark):
    old = spark.createDataFrame([("a", {"k": 0.5}), ("b", {"k": 5.0})], "id string, daily_data map<string,double>")
    new = spark.createDataFrame([("b", {"k": 5.0})], "id string, daily_data map<string,double>")
    df = revision.snapshot_delta(revision.snapshot_pair(old, new))
    assert dict(values(df, "id", "delta_changed")) == {"a": True, "b": False}


def test_pair_drops_a_single_week(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (2, 5)], "p int, week int")
    for spread in (False, True):
        got = windows.first_last_pair(df, "p", "week", spread=spread)
        assert sorted(values(got, "p", "week", "seq")) == [(2, 0, "first"), (2, 5, "last")]
        lone = windows.first_last_pair(df, "p", "week", lone=True, spread=spread)
        assert (1, 0, "first") in values(lone, "p", "week", "seq")


def test_latest_pivot_first_and_last(spark):
    start = ts("2024-01-01T08:00:00")
    rows = [(1, start + dt.timedelta(days=d), d, float(20 + d)) for d in (0, 31, 90)]
    measures = spark.createDataFrame(rows, "patient_id int, ts timestamp, reading_id int, bmi double")
    anchors = spark.createDataFrame([(1, start)], "patient_id int, enroll_ts timestamp")
    last = jobs.baseline_latest(measures, anchors).first()
    first = jobs.baseline_latest(measures, anchors, latest="first").first()
    assert (last["baseline_bmi"], last["latest_bmi"]) == (20.0, 110.0)
    assert first["latest_bmi"] == 51.0


def test_last_record_of_a_day_and_first_known_value(spark):
    start = ts("2024-01-01T07:00:00")
    rows = [(0, 6, 99.0), (0, 8, None), (0, 9, 25.0), (0, 20, 30.0), (1, 9, None), (2, 9, 31.0)]
    rows += [(40, 9, None), (41, 9, 20.0), (50, 8, 21.0), (50, 9, 22.0), (60, 9, None)]
    data = [(1, ts("2024-01-01T00:00:00") + dt.timedelta(days=d, hours=h), i, v) for i, (d, h, v) in enumerate(rows)]
    measures = spark.createDataFrame(data, "patient_id int, ts timestamp, reading_id int, bmi double")
    anchors = spark.createDataFrame([(1, start)], "patient_id int, enroll_ts timestamp")
    last = jobs.baseline_latest(measures, anchors).first()
    first = jobs.baseline_latest(measures, anchors, latest="first").first()
    assert (last["baseline_bmi"], last["latest_bmi"], first["latest_bmi"]) == (30.0, 22.0, 20.0)
    late = jobs.baseline_latest(measures.where("reading_id = 3 OR bmi IS NULL"), anchors).first()
    assert (late["baseline_bmi"], late["latest_bmi"], late["latest_grade"]) == (30.0, None, None)


def test_weight_job_counts_from_the_purchase(spark):
    paid = ts("2024-01-01T12:00:00")
    hour = lambda h: ts("2024-01-01T00:00:00") + dt.timedelta(hours=h)
    scale = spark.createDataFrame([(1, hour(8), 90.0), (1, hour(14), 30.0), (2, hour(200), 28.0)], "patient_id int, ts timestamp, bmi double")
    exams = spark.createDataFrame(
        [(2, hour(9), 1, 50.0), (2, hour(13), 2, 33.0), (2, hour(20), 3, 34.0), (2, hour(40), 4, 35.0)],
        "patient_id int, ts timestamp, reading_id int, bmi double",
    )
    starts = spark.createDataFrame([(p, ts("2024-01-01T00:00:00"), paid, p % 2) for p in (1, 2)], "patient_id int, start_date timestamp, paid_at timestamp, arm int")
    drugs = spark.createDataFrame([(2, hour(0), "some token")], "patient_id int, date timestamp, medicine string")
    got = {r["patient_id"]: r for r in jobs.weight_frame(scale, starts, exams, drugs, "token").collect()}
    assert (got[1]["week"], got[1]["bmi"], got[1]["base_bmi"], got[1]["drug"]) == (0, 30.0, 30.0, False)
    assert (got[2]["week"], got[2]["base_bmi"], got[2]["drug"]) == (1, 34.0, True)


def test_an_unknown_first_record_stays_unknown(spark):
    rows = [(1, ts("2024-01-01T00:00:00"), 1, None), (1, ts("2024-01-02T00:00:00"), 2, 20.0), (1, ts("2024-01-03T00:00:00"), 3, 25.0)]
    df = spark.createDataFrame(rows, "patient_id int, ts timestamp, reading_id int, bmi double")
    row = jobs.first_last_measure(df).first()
    assert (row["first_bmi"], row["last_bmi"]) == (None, 25.0)


def test_tenths_round_as_python_does(spark):
    import random

    random.seed(3)
    v = [round(i / 100, 2) for i in range(-700, 700)] + [random.uniform(-50, 50) for _ in range(500)]
    v += [0.25, 0.35, 0.45, 2.5, 5.35, 5.3, 1e13 + 0.25, -0.05, 0.0]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").select("v", S.round_tenth(F.col("v")).alias("r"))
    for r in df.collect():
        assert r["r"] == (None if r["v"] is None else round(r["v"], 1))
    old, new = {"a": 5.35}, {"a": 5.3}
    assert revision.map_diff(maps(spark, ("x", old, new))).first()["changed"] is (round(5.35, 1) != 5.3)


def test_ranks_keep_rows_without_an_order(spark):
    rows = [(1, ts("2024-01-01T00:00:00"), 1), (1, None, 2), (1, ts("2024-01-01T05:00:00"), 3), (None, ts("2024-01-01T00:00:00"), 4)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, i int")
    for chunk in (None, F.unix_micros("ts")):
        got = {r["i"]: (r["seq_asc"], r["seq_desc"]) for r in windows.seq_ranks(df, ["k"], "ts", chunk).collect()}
        assert got == {1: (1, 2), 2: (None, None), 3: (2, 1), 4: (None, None)}


def test_profile_without_numbers(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert shape.profile(df, "x").first()["n"] == 0 and shape.profile(df.where("x > 0"), "x").first()["n"] == 0
    times = df.select(F.col("x").cast("timestamp").alias("t"))
    assert shape.profile_time(times, "t").first().asDict() == {"n": 0, **dict.fromkeys(("mean", "min", "max", "q1", "median", "q3"))}


def test_readings_of_one_instant_have_their_own_keys(spark):
    from cohortflow.plans import bindings

    rows = [(1, ts("2024-01-01T00:00:01"), i, float(i)) for i in (5, 3)] + [(1, ts("2024-01-01T00:00:01.5"), 9, 9.0)]
    df = spark.createDataFrame(rows, "patient_id int, ts timestamp, reading_id int, glucose double").withColumn("date", F.to_date("ts"))
    row = bindings.per_key(df, ["patient_id", "date"], bindings.time_key(), F.col("glucose")).first()
    assert row["daily_data"] == {"00:00:01.000000": 3.0, "00:00:01.000000_5": 5.0, "00:00:01.500000": 9.0}
    frame = spark.createDataFrame([(row["date"], row["daily_data"])], "date date, m map<string,double>")
    assert sorted(values(shape.explode_day_map(frame, "date", "m"), "ts")) == [ts("2024-01-01T00:00:01")] * 2 + [ts("2024-01-01T00:00:01.5")]


def test_scratch_is_cleared(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert clear_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)


def weekly(spark, rows):
    return spark.createDataFrame(rows, "patient_id int, week int, bmi double, base_bmi double")


def test_rebound_rules(spark):
    rows = [(1, 0, 30.0, 28.0), (1, 1, 28.0, 28.0), (1, 4, 28.0, 28.0)]
    rows += [(2, 0, 30.0, 30.0), (2, 3, 25.0, 30.0)]
    rows += [(3, 0, 30.0, 30.0), (3, 1, 25.0, 30.0), (3, 2, 25.1, 30.0), (3, 6, 25.2, 30.0)]
    got = {r["patient_id"]: (r["T"], r["E"]) for r in survival.rebound_events(weekly(spark, rows)).collect()}
    assert got == {1: (3.0, 1), 2: (0.0, 0), 3: (5.0, 0)}


def test_glycaemia_risk_index(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, day, day, 100, 1, 2, 10, 5, 50, 8.0, 2.0, 1.0, 2.0)],
        "patient_id int, date date, first_date date, valid_data int, vlow int, low int, high int, vhigh int, "
        "in_range_tight int, mean double, std double, lbgi double, hbgi double",
    )
    row = cgm.weekly_rollup(df).first()
    assert row["GRI"] == pytest.approx(0.238)
    assert row["TIR"] + row["TBR"] + row["TAR"] == pytest.approx(1.0)
    assert (row["mean"], row["std"]) == (pytest.approx(8.0), pytest.approx(2.0))


def test_risk_scale_pins(spark):
    df = spark.createDataFrame([(3.0,), (6.25,), (15.0,)], "g double")
    got = values(df.select(cgm.risk_scale("g").alias("f")), "f")
    assert got == pytest.approx([-1.362898, 0.001204, 1.647090], abs=1e-6)
    assert [10 * f * f for f in got] == pytest.approx([18.574918, 0.000014, 27.129051], abs=1e-6)


def readings(spark, rows):
    data = [(p, ts(t), i, g) for i, (p, t, g) in enumerate(rows)]
    return spark.createDataFrame(data, "patient_id int, ts timestamp, reading_id int, glucose double")


def test_mage_and_mag_by_hand(spark):
    g = [5.0, 5.0, 9.0, 7.0, 7.0, 12.0, 4.0]
    rows = [(1, f"2024-01-01T0{i}:30:00", v) for i, v in enumerate(g)] + [(2, "2024-01-01T00:00:00", 6.0)]
    for chunk in (600, 3600, 7200, 86400):
        got = {r["patient_id"]: r for r in cgm.patient_metrics(readings(spark, rows), chunk_seconds=chunk).collect()}
        # Runs: +4, -2, +5, -8; the SD is 2.83, so -2 does not count.
        assert got[1]["MAGE"] == pytest.approx((4 + 5 + 8) / 3)
        assert got[1]["MAG"] == pytest.approx(19 / 6)
        assert got[2]["MAGE"] is None and got[2]["MAG"] is None and got[2]["sd"] is None
        assert got[2]["n"] == 1 and got[2]["TIR"] == 1.0


def test_bands_are_disjoint_and_complete(spark):
    g = [1.0, 2.9, 3.0, 3.89, 3.9, 7.8, 7.9, 10.0, 10.1, 13.9, 14.0]
    rows = [(1, f"2024-01-01T{i:02d}:00:00", v) for i, v in enumerate(g)]
    row = cgm.daily_summary(readings(spark, rows)).first()
    assert (row["data_count"], row["valid_data"]) == (11, 10)
    assert (row["vlow"], row["low"], row["high"], row["vhigh"], row["in_range_tight"]) == (1, 2, 2, 1, 2)


def test_exposure_must_be_consistent_and_known(spark):
    rows = [(1, True), (1, True), (2, True), (2, False), (3, None), (4, False), (4, None)]
    df = spark.createDataFrame(rows, "k int, f boolean")
    assert sorted(values(quality.consistent_exposure(df, "k", "f"), "k")) == [1, 1, 4, 4]


def test_adequate_week(spark):
    rows = [(p, w, p % 2) for w, n in ((0, 8), (1, 6), (2, 3), (3, 8)) for p in range(n)]
    df = spark.createDataFrame(rows, "patient_id int, week int, arm int")
    assert quality.adequate_week(df, "week", "arm", 3).first()["cut_week"] == 1
    assert quality.adequate_week(df, "week", "arm", 1).first()["cut_week"] == 3


def test_core_cohort_needs_every_week(spark):
    day = ts("2024-01-01T00:00:00")
    rows = [(1, w, 25.0, day) for w in (0, 1, 2)] + [(2, w, 25.0, day) for w in (0, 2)]
    rows += [(3, w, 25.0, ts("2024-01-15T00:00:00")) for w in (0, 1, 2)]
    df = spark.createDataFrame(rows, "patient_id int, week int, bmi double, start_date timestamp")
    assert set(values(quality.core_cohort(df, 2, "2024-01-16"), "patient_id")) == {1}


def test_start_date_takes_one_first_order(spark):
    people = spark.createDataFrame([(1, ts("2024-01-05T10:00:00")), (2, ts("2024-01-06T10:00:00"))], "patient_id int, enroll_ts timestamp")
    day = ts("2024-01-02T09:00:00")
    orders = spark.createDataFrame([(1, day, 7, True), (1, day, 8, False)], "patient_id int, paid_at timestamp, oid int, exposed boolean")
    got = {r["patient_id"]: (str(r["start_date"]), r["exposed"], r["is_paid"]) for r in quality.start_date(people, orders).collect()}
    assert got == {1: ("2024-01-02", True, True), 2: ("2024-01-06", False, False)}


def test_sort_by_category_keeps_the_given_order(spark):
    df = spark.createDataFrame([("b", 2), ("z", 0), ("a", 1), ("b", 1)], "c string, v int")
    got = values(shape.sort_by_category(df, "c", ["b", "a"], ["v"]), "c", "v")
    assert got == [("b", 1), ("b", 2), ("a", 1), ("z", 0)]


def test_pivot_takes_the_first_known_value(spark):
    rows = [(1, "x", 2, 5.0), (1, "x", 1, None), (1, "y", 1, 7.0)]
    df = spark.createDataFrame(rows, "k int, lab string, o int, v double")
    row = shape.pivot_first(df, "k", "lab", ["x", "y", "z"], ["v"], "o").first()
    assert (row["x_v"], row["y_v"], row["z_v"]) == (5.0, 7.0, None)


def test_net_orders(spark):
    orders = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0)], "oid int, fee double")
    back = spark.createDataFrame([(1, 4.0), (1, 5.0), (2, 5.0), (2, 5.0)], "oid int, total double")
    assert sorted(values(joins.net_orders(orders, back), "oid")) == [1, 3]


def test_crosswalk_keeps_unmapped_rows(spark):
    df = spark.createDataFrame([(1, "a"), (9, "b")], "k int, v string")
    pairs = spark.createDataFrame([(1, "P1")], "old int, new string")
    assert dict(values(joins.crosswalk(df, pairs, "k", "old", "new"), "v", "k")) == {"a": "P1", "b": None}


def test_text_that_is_no_time_becomes_null(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("n/a",)], "t string")
    assert values(C.to_ts(df, ["t"]), "t") == [ts("2024-01-01T10:00:00"), None]
    other = spark.createDataFrame([("01/02/2024",), ("x",)], "t string")
    assert values(C.to_ts(other, ["t"], "dd/MM/yyyy"), "t") == [ts("2024-02-01T00:00:00"), None]


def test_json_array_files_and_text_outside_ascii(spark):
    path = scratch_path(spark, "json")
    df = spark.createDataFrame([(1, "血糖"), (2, None)], "k int, t string")
    tables.write_json(df, path)
    raw = spark.read.text(path)
    assert raw.where(F.col("value").contains("血糖")).count() == 1
    assert sorted(values(tables.read_json_records(spark, path, df.schema), "k")) == [1, 2]
    lines = ",".join(r["value"] for r in raw.collect())
    array = scratch_path(spark, "array")
    spark.createDataFrame([(f"[{lines}]",)], "value string").write.text(array)
    assert tables.read_json_records(spark, array, df.schema, array=True).count() == 2


def test_materialize_modes(spark):
    df = spark.range(5)
    path = scratch_path(spark, "m")
    assert tables.materialize(df, path).count() == 5
    assert tables.materialize(df, path, "read").count() == 5
    assert tables.materialize(df, mode="checkpoint").count() == 5
    assert tables.materialize(df, mode="off") is df
    with pytest.raises(ValueError):
        tables.materialize(df)


def test_wide_table_windows(spark):
    start = ts("2024-01-01T00:00:00")
    base = spark.createDataFrame([(1, start), (2, start)], "patient_id int, d timestamp")
    rows = [(1, start + dt.timedelta(days=d), float(d)) for d in (0, 92, 93, 372, 373)]
    frame = spark.createDataFrame(rows, "patient_id int, ts timestamp, w double")
    got = {
        r["patient_id"]: r
        for r in jobs.wide_table(base, {"body": (frame, ["w"], "last"), "mean": (frame, ["w"], "mean")}, "d").collect()
    }
    assert [got[1][f"body_w_w{i}"] for i in range(1, 6)] == [92.0, 93.0, None, None, 372.0]
    assert got[1]["mean_w_w1"] == 46.0 and got[2]["body_w_w1"] is None
