"""Temperatures from out-of-fold predictions and strengths chosen over walk-forward folds, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import asof, guards
from oddsloom.operators import diagnostics, features, logit, seats, splits
from oddsloom.plans import jobs, league


@pytest.fixture(scope="module")
def small(spark, sf):
    t = league.tables(spark, sf)
    own = t.matches.where("cast(league as bigint) < 4")
    keep = own.select("match_id")
    return features.Tables(own, t.maps.join(keep, "match_id", "left_semi"), t.players.join(keep, "match_id", "left_semi"))


def days(spark, n, seed=0):
    """Matches with tied times and keys whose order is not that of their numbers."""
    rng = random.Random(seed)
    rows = [(f"m{i}", f"2026-01-{1 + rng.randrange(9):02} 0{rng.randrange(3)}:00:00") for i in range(n)]
    return spark.createDataFrame(rows, "match_id string, t string").select("match_id", F.to_timestamp_ntz("t").alias("ts")).repartition(3)


def test_bounds_are_the_blocks_of_the_folds(spark):
    m = days(spark, 60)
    split = splits.chronological_split(m, 0.2)
    bounds = splits.fold_bounds(split, 4, 8)
    assert bounds.folds == 4 and len(bounds.starts) == 5
    got = {r.match_id: r.b for r in m.select("match_id", bounds.block(F.col("ts"), F.col("match_id")).alias("b")).collect()}
    train = split.where("split = 'train'")
    roles = {(r.fold_id, r.match_id): r.role for r in splits.walk_forward_folds(train, 4, 8).collect()}
    assert {k for k, b in got.items() if b is None} == {r.match_id for r in split.where("split = 'test'").collect()}
    for (fold, k), role in roles.items():
        assert role == ("train" if got[k] <= fold else "validate") and (role == "train" or got[k] == fold + 1)
    assert splits.fold_bounds(split, 5, 20).folds == 1
    with pytest.raises(guards.IntegrityError):
        splits.fold_bounds(split, 5, 40)
    whole = splits.fold_bounds(split.withColumn("split", F.lit("train")), 2, 8)
    assert whole.end is None and m.select(whole.block(F.lit(None).cast("timestamp_ntz"), F.lit("x")).alias("b")).first().b is None


def noisy(spark, n=360, d=8, seed=2):
    """Rows whose many features say little: what is fitted on few of them is too sure of itself."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.digitize(0.4 * x[:, 0] + rng.logistic(size=n), [-1, 1])
    names = [f"x{i}" for i in range(d)]
    return spark.createDataFrame([(*map(float, v), int(c), i * 6 // n, i) for i, (v, c) in enumerate(zip(x, y, strict=True))], ", ".join([*[f"{c} double" for c in names], "y int", "block int", "id int"])), names


def test_folds_are_fits_over_earlier_blocks(spark):
    rows, names = noisy(spark)
    config = logit.FitConfig(l2=0.01)
    for kind, label in (("ordinal", "y"), ("multinomial", "y"), ("binary", "z")):
        own = rows.withColumn("z", (F.col("y") > 0).cast("int"))
        for f, model in enumerate(logit.fit_folds(own, names, label, kind, F.col("block"), 5, config)):
            one = logit.fit(own.where(F.col("block") <= f), names, label, kind, config)
            assert model.n == one.n == 60 * (f + 1) and model.converged
            assert np.allclose(model.mean, one.mean) and np.allclose(model.std, one.std)
            assert np.allclose(model.coef, one.coef, atol=1e-4) and np.allclose(model.cuts, one.cuts, atol=1e-4)


def nll(eta, cuts, y, t):
    edges = np.concatenate([np.zeros((len(eta), 1)), 1 / (1 + np.exp(-(cuts + eta[:, None] / t))), np.ones((len(eta), 1))], axis=1)
    return -np.log(np.clip(np.diff(edges)[np.arange(len(y)), y], 1e-12, 1 - 1e-12)).sum()


def test_the_temperature_is_of_rows_that_no_fit_has_seen(spark):
    rows, names = noisy(spark)
    config = logit.FitConfig(l2=0.01)
    t, loss, one, n = jobs.calibrate(rows, names, "y", config)
    assert n == 300
    etas, cuts, ys = [], [], []
    for b in range(1, 6):
        model = logit.fit(rows.where(F.col("block") < b), names, "y", "ordinal", config)
        for r in rows.where(F.col("block") == b).collect():
            etas.append(sum((r[f] - m) / s * c for f, m, s, c in zip(names, model.mean, model.std, model.coef, strict=True)))
            cuts.append(model.cuts)
            ys.append(r.y)
    eta, cut, y = np.array(etas), np.array(cuts), np.array(ys)
    coarse = np.append(np.geomspace(0.05, 20, 97), 1.0)
    losses = [nll(eta, cut, y, x) for x in coarse]
    at = coarse[int(np.argmin(losses))]
    fine = np.geomspace(at / 1.5, at * 1.5, 61)
    want = min(((nll(eta, cut, y, x), x) for x in [*coarse, *fine]))
    assert t == pytest.approx(want[1], rel=0.02) and loss == pytest.approx(want[0], abs=1e-3) and one == pytest.approx(losses[-1], abs=1e-2)
    model = logit.fit(rows, names, "y", "ordinal", config)
    seen = rows.select(logit.linear(model, model.coef).alias("eta"), F.array(*[F.lit(c) for c in model.cuts]).alias("cuts"), "y")
    inside = logit.fit_temperature(seen, "eta", "cuts", "y")[0]
    assert t > 1.1 * inside and loss <= one
    later = rows.withColumn("block", F.lit(None).cast("int")).withColumn("x0", F.col("x0") * 50)
    assert jobs.calibrate(rows.unionByName(later), names, "y", config) == pytest.approx((t, loss, one, n), rel=1e-6)
    with pytest.raises(guards.IntegrityError, match="no fold"):
        jobs.calibrate(rows.where("block = 0"), names, "y", config)


def test_temperatures_of_odd_rows(spark):
    schema = "eta double, cuts array<double>, y int"
    with pytest.raises(guards.IntegrityError, match="no rows"):
        logit.fit_temperature(spark.createDataFrame([], schema), "eta", "cuts", "y")
    for bad in ((0.1, [0.0], 2), (None, [0.0], 1), (0.1, [0.0], None), (0.1, [0.0], -1)):
        with pytest.raises(Exception, match="a row without a predictor"):
            logit.fit_temperature(spark.createDataFrame([bad], schema), "eta", "cuts", "y")
    sure = spark.createDataFrame([(5.0 * (-1) ** i, [0.0], int(i % 4 < 2)) for i in range(40)], schema)
    assert logit.fit_temperature(sure, "eta", "cuts", "y")[0] == pytest.approx(20.0)


def test_training_takes_its_temperature_out_of_fold(spark, small):
    split = splits.chronological_split(small.matches, check=False)
    d = jobs.design(league.feature_rows(small), small, jobs.labelled(small.maps), split).cache()
    assert d.where("split = 'test' and block is not null or split = 'train' and block is null").count() == 0
    assert d.agg(F.max("block")).first()[0] == 5
    config = logit.FitConfig(max_iter=30)
    trained = jobs.train(d, "ordinal", config)
    assert trained.n_calibration == d.where("split = 'train' and block > 0").count() and trained.loss <= trained.loss_at_one
    again = jobs.train(d.unionByName(d.where("split = 'test'").withColumn("outcome_ordinal", F.lit(0).cast("bigint"))), "ordinal", config)
    assert again.temperature == pytest.approx(trained.temperature) and np.allclose(again.model.coef, trained.model.coef)
    d.unpersist()


def by_loops(t, measure, grid):
    """Losses by strength of all validated rows, by plain loops over the ledger."""
    won, of, _ = diagnostics.MEASURES[measure]
    ledger = features.roster_ledger(t) if measure == "first_blood" else t.seat_ledger()
    rows = [r for r in ledger.withColumn("w", F.expr(won)).withColumn("n", F.expr(of)).collect() if r.w is not None and r.n]
    order = sorted(((r.ts, r.match_id) for r in t.matches.where("status = 'completed'").collect()))
    train = order[: len(order) - max(1, round(len(order) * 0.15))]
    folds = min(5, len(train) // 8 - 1)
    validated = {m for _, m in train[len(train) - folds * (len(train) // (folds + 1)) :]}
    known = {m for _, m in train}
    losses, total = {k: 0.0 for k in grid}, 0
    rows = [r for r in rows if r.match_id in known]
    for r in rows:
        if r.match_id not in validated:
            continue
        past = [e for e in rows if e.ts < r.ts]
        own = [e for e in past if e.team_id == r.team_id]
        here = [e for e in own if e.map_name == r.map_name]
        if measure == "win":
            prior = sum(e.w for e in own) / len(own) if own else 0.5
        elif measure == "first_blood":
            prior = (sum(e.w for e in own) + 25) / (sum(e.n for e in own) + 50)
        else:
            base = sum(e.w for e in past) / sum(e.n for e in past) if past else 0.5
            prior = (sum(e.w for e in own) + 50 * base) / (sum(e.n for e in own) + 50)
        total += r.n
        for k in grid:
            p = min(1 - 1e-12, max(1e-12, (sum(e.w for e in here) + k * prior) / (sum(e.n for e in here) + k)))
            losses[k] -= r.w * math.log(p) + (r.n - r.w) * math.log(1 - p)
    return {k: x / total for k, x in losses.items()}


@pytest.fixture(scope="module")
def tiny(spark, small):
    own = small.matches.where("cast(league as bigint) < 1")
    keep = own.select("match_id")
    return features.Tables(own, small.maps.join(keep, "match_id", "left_semi"), small.players.join(keep, "match_id", "left_semi"))


@pytest.mark.parametrize("measure", list(diagnostics.MEASURES))
def test_strengths_are_chosen_over_validated_rows(spark, tiny, measure):
    grid = [1.0, 10.0, 100.0]
    got = diagnostics.select_strength(tiny, measure, grid).collect()
    whole = {r.grid_value: r for r in got if r.fold_id is None}
    want = by_loops(tiny, measure, grid)
    assert {k: r.score for k, r in whole.items()} == pytest.approx(want)
    assert [k for k, r in whole.items() if r.is_best] == [min(grid, key=want.get)]
    parts = [r for r in got if r.fold_id is not None and r.grid_value == 1.0]
    assert sorted(r.fold_id for r in parts) == list(range(3)) and sum(r.n for r in parts) == whole[1.0].n
    assert whole[1.0].score == pytest.approx(sum(r.n * r.score for r in parts) / whole[1.0].n)


def test_held_out_matches_do_not_move_a_strength(spark, tiny):
    """Other outcomes of all matches that are held out change neither scores nor counts."""
    split = splits.chronological_split(tiny.matches.where("status = 'completed'"), check=False)
    test = split.where("split = 'test'").select("match_id", F.lit(True).alias("held"))
    swapped = tiny.maps.join(test, "match_id", "left").withColumn("s", F.col("team1_score"))
    swapped = swapped.withColumn("team1_score", F.when(F.col("held"), F.col("team2_score")).otherwise(F.col("team1_score")))
    swapped = swapped.withColumn("team2_score", F.when(F.col("held"), F.col("s")).otherwise(F.col("team2_score"))).drop("s", "held")
    other = features.Tables(tiny.matches, swapped, tiny.players)
    assert seats.finished_maps(other.matches, other.maps).exceptAll(tiny.finished()).count() > 0
    for measure in ("win", "attack"):
        a, b = ([tuple(r) for r in diagnostics.select_strength(t, measure).orderBy("fold_id", "grid_value").collect()] for t in (tiny, other))
        assert a == b


def test_hot_teams_do_not_move_a_strength(spark, tiny, monkeypatch):
    grid = [2.0, 20.0]
    cold = sorted(map(tuple, diagnostics.select_strength(tiny, "attack", grid).collect()), key=repr)
    monkeypatch.setattr(asof, "HOT_ROWS", 3)
    hot = features.Tables(tiny.matches, tiny.maps, tiny.players)
    assert hot.hot_teams.count() > 0
    got = sorted(map(tuple, diagnostics.select_strength(hot, "attack", grid).collect()), key=repr)
    assert [r[0] for r in got] == [r[0] for r in cold] and np.allclose([r[3] for r in got], [r[3] for r in cold])


def test_strengths_without_a_grid_or_measure(spark, tiny):
    with pytest.raises(ValueError, match="no measure"):
        diagnostics.select_strength(tiny, "luck")
    with pytest.raises(ValueError):
        diagnostics.select_strength(tiny, "win", [0.0])
