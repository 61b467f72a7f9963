"""Keyed tables: an upsert touches the parts of its keys alone, a point read scans them alone."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from oddsloom.functions.guards import IntegrityError
from oddsloom.sources.keyed import KeyedTable


def rows(spark, some):
    return spark.createDataFrame(some, "url string, at timestamp_ntz, body string") if some else spark.createDataFrame([], "url string, at timestamp_ntz, body string")


def at(day):
    import datetime

    return datetime.datetime(2026, 1, day)


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/cache", "url", "at", 8)
    t.put(rows(spark, [(f"u{i}", at(1), f"b{i}") for i in range(60)]))
    return t, f"{tmp_path}/cache"


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/part=*/*.parquet")}


def test_an_upsert_of_one_key_rewrites_one_part(spark, table):
    t, path = table
    before = files(path)
    touched = t.put(rows(spark, [("u3", at(2), "new")]))
    after = files(path)
    changed = {os.path.dirname(p) for p in set(before) ^ set(after)}
    assert changed == {f"{path}/part={touched[0]}"} and len(touched) == 1
    got = {r.url: r.body for r in t.rows().collect()}
    assert len(got) == 60 and got["u3"] == "new" and got["u4"] == "b4"
    assert t.put(rows(spark, [])) == [] and files(path) == after


def test_ties_go_by_time_and_text_and_new_keys_come_in(spark, table):
    t, _ = table
    t.put(rows(spark, [("u1", at(2), "p"), ("u1", at(3), "q"), ("u1", at(3), "r"), ("n", at(1), "z")]).repartition(4))
    got = {r.url: r.body for r in t.rows().collect()}
    assert got["u1"] == "r" and got["n"] == "z" and t.keys().count() == 61 and t.keys().columns == ["url"]
    with pytest.raises(IntegrityError, match="without a url"):
        t.put(rows(spark, [(None, at(1), "x")]))
    with pytest.raises(IntegrityError, match="columns"):
        t.put(rows(spark, [("u1", at(1), "x")]).withColumn("more", F.lit(1)))
    assert t.rows().count() == 61


def test_a_point_read_scans_its_parts(spark, table):
    t, path = table
    got = t.get(["u7", "nobody"])
    assert [(r.url, r.body) for r in got.collect()] == [("u7", "b7")]
    part = spark.createDataFrame([("u7",)], "url string").select(t.part()).first()[0]
    plan = t.get(["u7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and str(part) in plan
    read = t.get(["u7"]).select(F.input_file_name().alias("f"))
    scanned = spark.read.parquet(path).where(F.col("part").isin([part])).select(F.input_file_name()).distinct().count()
    assert scanned < len(files(path)) and read.count() == 1
    assert t.get([]).count() == 0 and t.get([None]).count() == 0
    assert t.get(rows(spark, [("u5", at(1), ""), ("u5", at(1), ""), ("u6", at(1), "")])).count() == 2


def test_what_is_missing_or_too_old(spark, table):
    t, _ = table
    t.put(rows(spark, [("u2", at(20), "young")]))
    wanted = rows(spark, [("u1", None, ""), ("u2", None, ""), ("other", None, ""), ("other", None, ""), (None, None, "")])
    assert sorted(r.url for r in t.missing(wanted).collect()) == ["other"]
    now = F.lit("2026-01-21 00:00:00").cast("timestamp")
    assert sorted(r.url for r in t.missing(wanted, now, 2 * 86_400).collect()) == ["other", "u1"]
    empty = KeyedTable(spark, t.path + "-none", "url", "at")
    assert sorted(r.url for r in empty.missing(wanted).collect()) == ["other", "u1", "u2"]
