"""Delimited and array files that are read in pieces of bytes."""

import csv
import json
import random

import pytest

from cohortflow.session import scratch_path
from cohortflow.sources import records, tables

SCHEMA = "id int, text string, more string, x double"
TEXTS = ["plain", "", None, "a\nb", '"', '""', 'say "hi",\nthen "bye"', "\n", "\n\n", ",", " kept ", "é日本 {}[]",
         "x,y\n\n\n z", "back\\slash", "tab\t", "null", '\\"', "a\\\nb"]


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records and their states run across many of them."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(TEXTS), rng.choice(TEXTS), rng.choice([None, 0.5, -2.0])) for i in range(n)]


def collected(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_texts_come_back_as_they_were(spark, small_blocks):
    rows = rows_of(120)
    path = scratch_path(spark, "csv")
    tables.write_csv(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    assert collected(tables.read_csv(spark, path, SCHEMA)) == rows


def test_one_large_file_is_read_by_many_tasks(spark, small_blocks, tmp_path):
    rows = rows_of(60, 2)
    path = tmp_path / "one.csv"
    with path.open("w", newline="") as f:
        write = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_NONNUMERIC)
        write.writerow(["id", "text", "more", "x"])
        write.writerows([(i, t or "", m or "", 1.0) for i, t, m, _ in rows])
    got = collected(tables.read_csv(spark, str(path), SCHEMA))
    assert got == [(i, t or "", m or "", 1.0) for i, t, m, _ in rows]
    assert records.pieces(spark, str(path), "\n").rdd.getNumPartitions() > 5


def test_line_ends_of_both_kinds_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,text,more,x\r\n1,"a\r\nb",c,2\r\n2,,"",\r\n')
    (tmp_path / "b.csv").write_bytes(b"id,text,more,x\n3,d,e,4")
    (tmp_path / "c.csv").write_bytes(b"id,text,more,x\n")
    (tmp_path / "d.csv").write_bytes(b"")
    got = collected(tables.read_csv(spark, str(tmp_path), SCHEMA))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, "c", 2.0), (2, "", None), (3, "e", 4.0)]
    assert got[0][1].split() == ["a", "b"] and got[1][1] is None


def objects(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        nested = {"a": rng.choice(TEXTS), "deep": {"b": "}{", "l": [{"c": '"}'}]}}
        out.append({"id": i, "text": rng.choice(TEXTS), "nested": nested, "x": rng.random()})
    return out


JSON = "id int, text string, x double, nested struct<a: string, deep: struct<b: string, l: array<struct<c: string>>>>"


@pytest.mark.parametrize("indent", [None, 2])
def test_an_array_is_read_by_many_tasks(spark, small_blocks, tmp_path, indent):
    rows = objects(40)
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    df = tables.read_json_records(spark, str(path), JSON, array=True)
    got = [r.asDict(recursive=True) for r in df.orderBy("id").collect()]
    assert got == [{k: r[k] for k in ("id", "text", "x", "nested")} for r in rows]
    assert records.pieces(spark, str(path), "}").rdd.getNumPartitions() > 5


def test_arrays_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]\n')
    (tmp_path / "b.json").write_text('[\n{"id": 3, "text": "}"}\n]')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('[{}]')
    got = tables.read_json_records(spark, str(tmp_path), "id int, text string", array=True).collect()
    assert sorted(((r["id"], r["text"]) for r in got), key=str) == [(1, None), (2, None), (3, "}"), (None, None)]


def test_the_plan_has_no_task_for_a_whole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    plan = tables.read_csv(spark, str(tmp_path), "id int")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("n", [0, 1, 7])
def test_array_files_are_arrays(spark, n):
    path = scratch_path(spark, "arrays")
    rows = [(i, TEXTS[i]) for i in range(n)]
    tables.write_json_array(spark.createDataFrame(rows, "id int, text string").coalesce(1), path)
    (whole,) = [f[1] for f in spark.sparkContext.wholeTextFiles(path).collect()]
    assert json.loads(whole) == [{"id": i, "text": t} for i, t in rows]
