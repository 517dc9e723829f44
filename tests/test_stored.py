"""Frames that are kept by key or partition, and windows of a hot patient."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import joins as J
from cohortflow.plans import jobs
from cohortflow.plans import queries_models as Q
from cohortflow.session import scratch_path
from cohortflow.sources import tables


def final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_frames_kept_by_patient_need_no_shuffle(spark, base):
    frames = Q.stored_frames(spark, base)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jobs.weight_frame(*frames, "small ring", kept=True)
        plan = final(kept)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert kept.count() == Q.frame_of(spark, base).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def stored(spark):
    rows = [(i, f"old{i}", i % 4) for i in range(40)] + [(100, "alone", 9), (None, "no id", 1)]
    path = scratch_path(spark, "stored")
    spark.createDataFrame(rows, "id int, text string, part int").write.partitionBy("part").parquet(path)
    return path


def held(spark, path):
    return sorted((r["id"] or -1, r["text"], r["part"]) for r in spark.read.parquet(path).collect())


def files(spark, path):
    return {f for f in spark.read.parquet(path).inputFiles()}


def test_replacement_touches_its_partitions_only(spark):
    path = stored(spark)
    before, old_files = held(spark, path), files(spark, path)
    new = spark.createDataFrame([(4, "new4", 0), (4, "more", 5), (200, "new", 0)], "id int, text string, part int")
    touched = tables.replace_stored(spark, path, new, "id", "part", scratch_path(spark, "staged"))
    assert touched == ["0", "5"]
    want = sorted([r for r in before if r[0] != 4] + [(4, "new4", 0), (4, "more", 5), (200, "new", 0)])
    assert held(spark, path) == want
    same = {f for f in old_files if "part=0" not in f}
    assert same <= files(spark, path)
    tables.replace_stored(spark, path, new, "id", "part", scratch_path(spark, "staged"))
    assert held(spark, path) == want


def test_a_partition_that_gets_empty_goes(spark):
    path = stored(spark)
    before = held(spark, path)
    none = spark.createDataFrame([], "id int, text string, part int")
    ids = spark.createDataFrame([(100,), (3,), (None,)], "id int")
    assert tables.replace_stored(spark, path, none, "id", "part", scratch_path(spark, "staged"), ids) == ["3", "9"]
    assert held(spark, path) == [r for r in before if r[0] not in (100, 3)]


def test_a_run_that_broke_off_goes_on_from_its_staged_folder(spark, monkeypatch):
    path, staged = stored(spark), scratch_path(spark, "staged")
    before = held(spark, path)
    new = spark.createDataFrame([(4, "new4", 0), (100, "moved", 2)], "id int, text string, part int")
    removed = tables._removed

    def broken(spark, target):
        if target.endswith("part=9"):
            raise RuntimeError("lost")
        removed(spark, target)

    monkeypatch.setattr(tables, "_removed", broken)
    with pytest.raises(RuntimeError):
        tables.replace_stored(spark, path, new, "id", "part", staged)
    monkeypatch.undo()
    # Worse than a late failure: a partition was deleted before its new files were moved in.
    tables._removed(spark, f"{path}/part=0")
    tables.replace_stored(spark, path, new, "id", "part", staged)
    assert held(spark, path) == sorted(
        [r for r in before if r[0] not in (4, 100)] + [(4, "new4", 0), (100, "moved", 2)]
    )


def test_windows_of_a_hot_patient_lie_in_many_tasks(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1 if i % 3 == 0 else 2 + i % 40, start + dt.timedelta(minutes=37 * i), i) for i in range(3000)]
    events = spark.createDataFrame(rows, "k int, ts timestamp, id int")
    anchors = spark.createDataFrame(
        [(k, start + dt.timedelta(days=d, hours=5)) for k in range(1, 42) for d in (0, 20, 21, 60)],
        "k int, anchor timestamp",
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for lo, hi, days in [(-2, 30, 1), (0, 6, 3), (0, 0, 7), (-10, -5, 2)]:
            plain = J.anchored_window(events, anchors, "k", "ts", "anchor", lo, hi)
            spread = J.anchored_window(events, anchors, "k", "ts", "anchor", lo, hi, spread_days=days)
            assert sorted(map(tuple, spread.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spread = J.anchored_window(events, anchors, "k", "ts", "anchor", -2, 40, spread_days=1)
        tasks = spread.where("k = 1").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    with pytest.raises(ValueError, match="two ends"):
        J.anchored_window(events, anchors, "k", "ts", "anchor", 0, None, spread_days=1)

