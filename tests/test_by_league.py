"""The matrix league by league: the same rows as by levels, and one shuffle of matches."""

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import asof
from oddsloom.operators import by_league, features
from oddsloom.plans import league


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with unknown teams, times, parts and suppliers here and there, and orders without items."""
    source, folder = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("odd"))
    o, items = spark.read.parquet(f"{source}/orders.parquet"), spark.read.parquet(f"{source}/lineitem.parquet")
    key = F.col("o_orderkey")
    o = o.withColumn("o_custkey", F.when(key % 29 != 0, F.col("o_custkey"))).withColumn("o_orderdate", F.when(key % 31 != 0, F.col("o_orderdate")))
    o.write.parquet(f"{folder}/orders.parquet")
    key = F.col("l_orderkey")
    items = items.where(key % 17 != 0).withColumn("l_partkey", F.when((key + F.col("l_linenumber")) % 23 != 0, F.col("l_partkey"))).withColumn("l_suppkey", F.when((key + F.col("l_linenumber")) % 19 != 0, F.col("l_suppkey")))
    items.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def rounded(df):
    return df.select(*features.ROW, *[F.round(c, 9).alias(c) for c in df.columns if c not in features.ROW])


def test_the_matrix_is_the_same_by_league_and_by_levels(spark, odd, monkeypatch):
    plain, t = league.tables(spark, odd), league.tables(spark, odd)
    assert not plain.leagues_apart
    want = rounded(features.feature_matrix(plain.rows, plain)).cache()
    monkeypatch.setattr(features, "LEAST_MAPS", 0)
    assert t.leagues_apart
    got = rounded(features.feature_matrix(t.rows, t)).cache()
    assert got.count() == want.count() > 4000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # Each feature tells something, so equal columns are not empty ones.
    assert min(got.agg(*[F.count_distinct(c) for c in features.FEATURES]).first()) > 2
    without = rounded(features.feature_matrix(t.rows, t, rating=False))
    assert without.columns == [c for c in got.columns if c != "elo_differential"] and without.exceptAll(got.drop("elo_differential")).isEmpty()


def test_matches_are_dealt_once_and_sides_do_not_meet_again(spark, odd, monkeypatch):
    monkeypatch.setattr(features, "LEAST_MAPS", 0)
    t = league.tables(spark, odd)
    plan = features.feature_matrix(t.rows, t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(league") == 1
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(match_id" in line or "Exchange hashpartitioning(team_id" in line]
    assert "_ratings" not in t.__dict__ and "_rosters" not in t.__dict__


def test_a_team_of_two_leagues_or_a_large_league_is_read_by_levels(spark, odd, monkeypatch):
    monkeypatch.setattr(features, "LEAST_MAPS", 0)
    t = league.tables(spark, odd)
    assert by_league.apart(t)
    moved = t.every_match.withColumn("league", F.when(F.col("match_id").cast("long") % 3 == 0, "other").otherwise(F.col("league")))
    assert not by_league.apart(features.Tables(t.matches, t.maps, every_match=moved))
    monkeypatch.setattr(asof, "HOT_ROWS", 10)
    assert not by_league.apart(t)
