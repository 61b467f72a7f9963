"""Veto training sets and arms, the harness, replicates, series, predictions and their wire form."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import draws, guards
from oddsloom.operators import contract, features, harness, logit, reports, series_eval, splits, veto_steps
from oddsloom.plans import jobs, league, provenance
from oddsloom.plans.predict import Knobs, Predictor
from oddsloom.sources import documents

POOL = list("abcdefg")


@pytest.fixture(scope="module")
def small(spark, sf):
    """The league of few circuits, stored."""
    t = league.tables(spark, sf)
    own = t.matches.where("cast(league as bigint) < 4")
    keep = own.select("match_id")
    return features.Tables(own, t.maps.join(keep, "match_id", "left_semi"), t.players.join(keep, "match_id", "left_semi"))


def vetoes(spark, order="badcefg", match="m"):
    actions = ["ban", "ban", "pick", "pick", "ban", "ban", "decider"]
    rows = [(match, i, actions[i], None if i == 6 else ["t1", "t2"][i % 2], m) for i, m in enumerate(order)]
    return spark.createDataFrame(rows, "match_id string, step_index int, action string, team_id string, map_name string")


def match(spark, match="m"):
    return spark.createDataFrame([(match, "2026-01-01", "t1", "t2")], "match_id string, d string, team1_id string, team2_id string").withColumn("ts", F.to_timestamp_ntz("d")).drop("d")


def test_candidates_are_the_maps_that_were_left(spark):
    got = veto_steps.candidates(vetoes(spark), match(spark), POOL).collect()
    assert len(got) == 7 + 6 + 5 + 4 + 3 + 2
    third = {r.map_name: r for r in got if r.step_index == 2}
    assert set(third) == set("dcefg") and third["d"].chosen and not third["c"].chosen
    assert all((r.team_id, r.opponent_id) == (("t1", "t2") if r.step_index % 2 == 0 else ("t2", "t1")) for r in got)
    for wrong in (vetoes(spark, "aadcefg"), vetoes(spark).where("step_index <> 1"), vetoes(spark, "badcefx")):
        with pytest.raises(Exception, match="not a veto over the pool"):
            veto_steps.candidates(wrong, match(spark), POOL).collect()


def test_teams_of_vetoes_are_checked(spark):
    teams = spark.createDataFrame([("A", "t1"), ("B", "t2"), ("C", "t3")], "team string, team_id string")
    named = vetoes(spark).withColumn("team", F.when(F.col("team_id") == "t1", "A").when(F.col("team_id") == "t2", "B")).drop("team_id")
    assert veto_steps.checked_abbreviations(named, match(spark), teams).count() == 0
    other = named.replace("B", "C", "team").unionByName(named.replace("B", "?", "team").replace("m", "n", "match_id"))
    both = match(spark).unionByName(match(spark, "n"))
    assert {r.match_id: r.reason for r in veto_steps.checked_abbreviations(other, both, teams).collect()} == {"m": "other teams", "n": "unknown abbreviation"}
    assert veto_steps.with_team_ids(named, teams).where("team_id is null").count() == 1


def test_steps_are_scored_with_ties_by_name(spark):
    rows = veto_steps.uniform(veto_steps.candidates(vetoes(spark), match(spark), POOL))
    got = {r.step_index: r for r in veto_steps.score_steps(rows).collect()}
    # Chances are equal, so a map's rank is its place by name among those left: b of abcdefg, then a of acdefg.
    assert [got[i]["rank"] for i in range(6)] == [2, 1, 2, 1, 1, 1]
    assert got[0].cross_entropy == pytest.approx(math.log(7)) and got[0].top3 and not got[0].top1
    report = {r.step_index: r for r in veto_steps.step_report(veto_steps.score_steps(rows)).collect()}
    assert report[None].n_steps == 6 and report[None].top1_accuracy == pytest.approx(4 / 6) and len(report) == 7
    scored = veto_steps.score_steps(rows)
    same = {r.arm: r for r in veto_steps.compare_arms({"a": scored, "b": scored}, "a").collect()}
    assert same["b"].delta_cross_entropy == 0 and same["b"].n_steps == 6
    with pytest.raises(Exception, match="different steps"):
        veto_steps.compare_arms({"a": scored, "b": scored.where("step_index > 0")}, "a").collect()
    with pytest.raises(ValueError):
        veto_steps.compare_arms({"a": scored}, "c")


def test_frequency_counts_earlier_maps_of_any_status(spark):
    m = match(spark).unionByName(match(spark, "old").withColumn("ts", F.lit("2025-12-31").cast("timestamp_ntz")))
    maps = spark.createDataFrame([("old", x, "t1") for x in "aab"] + [("m", "c", "t1"), ("old", "d", None)], "match_id string, map_name string, winner string")
    rows = veto_steps.by_frequency(veto_steps.candidates(vetoes(spark), m, POOL), m, maps)
    p = {r.map_name: r.p for r in rows.where("step_index = 0").collect()}
    assert p["a"] == pytest.approx(2 / 3) and p["b"] == pytest.approx(1 / 3) and p["c"] < 1e-11
    assert {r.p for r in rows.where("step_index = 4").collect()} == {1 / 3}


def test_choices_of_a_league(spark, sf, small):
    rows = veto_steps.candidates(league.vetoes(spark, sf).join(small.matches.select("match_id"), "match_id", "left_semi"), small.matches, league.MAP_NAMES)
    rated = veto_steps.with_rates(rows, small).cache()
    models = {a: veto_steps.choice_model(rated, a) for a in ("ban", "pick")}
    assert all(m.converged and len(m.coef) == 5 for m in models.values())
    p = veto_steps.by_choice(rated, models)
    total = p.groupBy(*veto_steps.STEP).agg(F.sum("p").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    mean = {n: veto_steps.step_report(veto_steps.score_steps(f)).where("step_index is null").first().mean_cross_entropy for n, f in (("choice", p), ("uniform", veto_steps.uniform(rated)))}
    assert mean["choice"] <= mean["uniform"] + 1e-6
    with pytest.raises(Exception, match="no model for the action"):
        veto_steps.by_choice(rated, {"ban": models["ban"]}).collect()
    rated.unpersist()


def test_replicates_are_fits_over_repeated_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1.0, 5.0] + [0.0, 100.0]
    y = np.digitize(x[:, 0] - (x[:, 1] - 100) / 5 + rng.logistic(size=400), [-1, 1])
    rows = spark.createDataFrame([(f"m{i // 4}", float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "match_id string, u double, v double, y int")
    for kind, label in (("ordinal", "y"), ("multinomial", "y"), ("binary", "z")):
        own = rows.withColumn("z", (F.col("y") > 0).cast("int"))
        many = logit.fit_replicates(own, ["u", "v"], label, kind, 3, 11)
        for r, model in enumerate(many):
            one = logit.fit(reports.resampled(own, "match_id", r, 11), ["u", "v"], label, kind)
            assert model.n == one.n and model.converged and one.converged
            assert np.allclose(model.mean, one.mean) and np.allclose(model.std, one.std)
            assert np.allclose(model.coef, one.coef, atol=1e-4) and np.allclose(model.cuts, one.cuts, atol=1e-4)
            assert model.loss == pytest.approx(one.loss, abs=1e-7)
        bands = logit.replicate_bands(own.withColumn("id", F.monotonically_increasing_id()), ["id"], many, 0.9).first()
        assert all(a <= b for a, b in zip(bands.low, bands.high, strict=True))
    got = own.limit(5).select(logit.probabilities(many[0]).alias("p"), "u", "v").collect()
    assert np.allclose([r.p for r in got], logit.vectors(many[0], np.array([[r.u, r.v] for r in got])))


def test_draws_are_alike_in_columns_arrays_and_sql(spark):
    import duckdb

    keys = [0, 1, 17, 99_991, draws.PRIME - 1]
    want = draws.units(np.array(keys), 3, 5)
    rows = spark.createDataFrame([(k, r) for k in keys for r in range(3)], "k long, r int")
    got = {(r.k, r.r): r.u for r in rows.select("k", "r", draws.unit(F.col("k"), F.col("r").cast("bigint"), 5).alias("u")).collect()}
    assert all(got[k, r] == want[i, r] for i, k in enumerate(keys) for r in range(3))
    for i, k in enumerate(keys):
        assert duckdb.sql(f"SELECT {draws.unit_sql(f'CAST({k} AS BIGINT)', 'CAST(2 AS BIGINT)', 5)}").fetchall()[0][0] == pytest.approx(want[i, 2], abs=1e-15)
    u = draws.units(np.arange(20_000), 20, 3)
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.03
    assert abs(draws.poisson_times(u).mean() - 1) < 0.01


def test_searches_find_the_minimum_in_few_passes():
    def bowl(x):
        d = np.array([1.0, 30.0, 900.0])
        return float(d @ (x - 1) ** 2 / 2), d * (x - 1)

    calls = []
    x, f, _, ok = logit.descend(lambda p: (calls.append(1), bowl(p))[1], np.zeros(3), logit.FitConfig())
    assert ok and np.allclose(x, 1, atol=1e-5) and len(calls) < 60
    _, _, n, ok = logit.descend(bowl, np.zeros(3), logit.FitConfig(max_iter=2))
    assert n == 2 and not ok


def test_harness(spark, sf, small):
    split = splits.chronological_split(small.matches, check=False)
    rows = harness.held_out_maps(small, jobs.labelled(small.maps), split)
    design = jobs.design(league.feature_rows(small), small, jobs.labelled(small.maps), split).where("split = 'train'")
    models = {n: jobs.MODELS[n](design, logit.FitConfig()) for n in ("four_way_baseline", "ordinal", "binary")}
    out = {r.model: r for r in harness.compare_models({n: models[n] for n in ("four_way_baseline", "ordinal")}, rows, small).collect()}
    assert out["ordinal"].n_eval == out["four_way_baseline"].n_eval == rows.count() > 0
    assert 0 < out["ordinal"].mean_log_loss < 3 and out["ordinal"].worst_category in harness.LABELS
    p = models["binary"](rows.drop("outcome_ordinal"), small).first().p
    assert p[1] == p[2] == 0 and sum(p) == pytest.approx(1)
    gaps = {r.category: r.gap for r in harness.calibration(harness.score_held_out(models["ordinal"], rows, small)).collect()}
    assert max(gaps, key=gaps.get) == out["ordinal"].worst_category
    with pytest.raises(Exception, match="no prediction for"):
        harness.score_held_out(lambda r, t: models["ordinal"](r, t).where("map_index > 0"), rows, small).collect()


def test_walk_forward(spark):
    m = spark.createDataFrame([(f"m{i:02}", f"2026-01-{1 + i:02}", float(i)) for i in range(20)], "match_id string, d string, x double").withColumn("ts", F.to_timestamp_ntz("d"))
    folds = splits.walk_forward_folds(m, 3)

    def fit(train):
        mean = train.agg(F.avg("x")).first()[0]
        return lambda rows: rows.select("match_id", "x", F.lit(mean).alias("mean"))

    out = harness.walk_forward(m, folds, fit).collect()
    assert len(out) == 15
    for r in out:
        assert r.mean == np.mean([i for i in range(5 + 5 * r.fold_id)]) and r.x >= 5 + 5 * r.fold_id
    assert splits.assemble_out_of_fold(folds, spark.createDataFrame(out)).count() == 15


def test_series(spark):
    rows = spark.createDataFrame([(1, 0.7), (3, 0.7), (5, 0.5), (2, 0.5)], "best_of int, p double").withColumn("v", series_eval.flat_vector(F.col("p"), F.col("best_of")))
    v = {r.best_of: r.v for r in rows.collect()}
    assert v[1] == pytest.approx([0.7, 0.3]) and v[2] is None and sum(v[5]) == pytest.approx(1)
    assert v[3] == pytest.approx([0.49, 2 * 0.49 * 0.3, 2 * 0.7 * 0.09, 0.09])
    places = spark.createDataFrame([(3, 2, 0), (3, 1, 2), (5, 0, 3), (5, 2, 2), (1, 0, 1)], "n int, a int, b int").select(series_eval.outcome_index(F.col("a"), F.col("b"), F.col("n")).alias("i"))
    assert [r.i for r in places.collect()] == [0, 2, 5, None, 1]
    scored = rows.where("best_of = 3").select("best_of", F.col("v").alias("probabilities"), F.explode(F.array(F.lit(0), F.lit(3), F.lit(1), F.lit(1))).alias("outcome_index"))
    r = series_eval.sweep_report(scored).first()
    assert r.n_eval == 4 and r.observed_sweep == 0.5 and r.predicted_sweep == pytest.approx(0.58) and r.gap_b == pytest.approx(0.09 - 0.25)
    s = series_eval.series_scores(scored).collect()
    assert [x.correct for x in s] == [True, False, True, True] and s[0].log_loss == pytest.approx(-math.log(0.49))
    c = np.cumsum(v[3])[:3]
    assert s[1].rps == pytest.approx(sum(c**2))
    with pytest.raises(Exception, match="another length"):
        series_eval.sweep_report(scored.withColumn("best_of", F.lit(5))).collect()


def test_series_end_where_their_maps_decide_them(spark):
    games = {"m1": (3, "aab"), "m2": (3, "abb"), "m3": (3, "ab"), "m4": (1, "ba"), "m5": (5, "babab"), "m6": (5, "aaabb"), "m7": (2, "aa"), "m8": (3, "a?a")}
    matches = spark.createDataFrame([(k, n, "completed") for k, (n, _) in games.items()] + [("up", 3, "upcoming")], "match_id string, best_of int, status string")
    rows = [(k, i, *((13, 7) if w != "b" else (7, 13)), None if w == "?" else w) for k, (_, ws) in {**games, "up": (3, "aa")}.items() for i, w in enumerate(ws)]
    maps = spark.createDataFrame(rows, "match_id string, map_index int, team1_score int, team2_score int, winner string").repartition(3)
    got = {r.match_id: (r.wins1, r.wins2, r.outcome_index) for r in series_eval.series_outcomes(matches, maps).collect()}
    assert got == {"m1": (2, 0, 0), "m2": (1, 2, 2), "m4": (0, 1, 1), "m5": (2, 3, 3), "m6": (3, 0, 0), "m8": (2, 0, 0)}
    assert series_eval.series_outcomes(matches.limit(0), maps).count() == 0


def test_flat_series_of_a_league(spark, small):
    rows = small.matches.select("match_id", "ts", F.lit(3).alias("best_of"), "team1_id", "team2_id")
    got = series_eval.flat_series(rows, small)
    assert got.count() == rows.count() and got.where("p_map < 0 or p_map > 1").count() == 0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=1000).round(2), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0], [999, 1]), None: rng.random(77) * 1e9}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None)], "g string, x double")
    for r in reports.percentile_band(rows, ["g"], "x", 0.05, 0.95).collect():
        assert [r.low, r.high] == pytest.approx(np.percentile(values[r.g], [5, 95]).tolist())
    assert reports.percentile_band(rows.where("false"), ["g"], "x").count() == 0


def test_predictions_and_their_wire_form(spark, sf, small, tmp_path):
    split = splits.chronological_split(small.matches, check=False)
    d = jobs.design(league.feature_rows(small), small, jobs.labelled(small.maps), split)
    trained = jobs.train(d, "ordinal")
    rows = veto_steps.with_rates(veto_steps.candidates(league.vetoes(spark, sf).join(small.matches.select("match_id"), "match_id", "left_semi"), small.matches, league.MAP_NAMES), small)
    choices = {a: veto_steps.choice_model(rows, a) for a in ("ban", "pick")}
    teams = [r.team1_id for r in small.matches.select("team1_id").distinct().orderBy("team1_id").limit(3).collect()]
    fixtures = spark.createDataFrame([("f1", teams[0], teams[1], "Circuit Stage 2", 3), ("f2", teams[1], teams[2], "Circuit Stage 1", 5)], "match_id string, team1_id string, team2_id string, event_name string, best_of int")
    fixtures = fixtures.withColumn("ts", F.lit("1999-01-01 10:00:00").cast("timestamp_ntz"))
    replicates = jobs.train_replicates(d, "ordinal", 3, 5, logit.FitConfig(max_iter=15))
    predictor = Predictor(small, trained, choices, league.MAP_NAMES, Knobs(n_samples=12, top_n=3), replicates)
    forecast = predictor.answer(fixtures)
    assert sorted(forecast.samples.groupBy("match_id").count().collect()) == [("f1", 12), ("f2", 12)]
    vectors = {r.match_id: r.probabilities for r in forecast.series().collect()}
    assert len(vectors["f1"]) == 4 and len(vectors["f2"]) == 6 and all(sum(v) == pytest.approx(1, abs=1e-6) for v in vectors.values())
    assert forecast.maps.count() == 14
    exact = {r.match_id: r for r in forecast.exact().collect()}
    assert all(sum(r.probabilities) == pytest.approx(1, abs=1e-9) and np.allclose(r.probabilities, vectors[k], atol=0.2) for k, r in exact.items())
    ranked = forecast.ranked().collect()
    assert len(ranked) == 6 and all(len(r.played) == exact[r.match_id].best_of for r in ranked)
    drawn = {(r.match_id, tuple(r.sequence)): r.p for r in forecast.samples.collect()}
    assert all(r.p >= max(p for (m, _), p in drawn.items() if m == r.match_id) * (1 - 1e-9) for r in ranked if r["rank"] == 1)
    bands = {r.match_id: r for r in forecast.sensitivity().collect()}
    assert bands["f1"].n == 12 and bands["f1"].low <= bands["f1"].mean + 1e-9 <= bands["f1"].high + 1e-6 + 1
    again = predictor.answer(fixtures.repartition(3))
    assert sorted(map(repr, again.samples.select("match_id", "draw", "sequence").collect())) == sorted(map(repr, forecast.samples.select("match_id", "draw", "sequence").collect()))
    moved = {r.match_id: r for r in forecast.bands().collect()}
    assert set(moved) == {"f1", "f2"} and all(r.n == 3 and 0 <= r.low <= r.mean <= r.high <= 1 for r in moved.values())
    artifact = forecast.artifact().cache()
    cells = [m for r in artifact.collect() for m in r.overall.maps]
    assert len(cells) == 14 and all(lo <= p <= hi for m in cells for lo, p, hi in zip(m.low, m.probabilities, m.high, strict=True))
    upside = artifact.withColumn("overall", F.col("overall").withField("maps", F.transform("overall.maps", lambda m: m.withField("low", m["high"]).withField("high", m["low"]))))
    assert {r.reason for r in contract.breaches(upside).collect()} == {"a band is upside down"}
    assert contract.breaches(artifact).count() == 0
    root = dict.fromkeys(contract.ROOT, "x")
    path = f"{tmp_path}/out/predictions"
    for _ in range(2):
        contract.write_artifact(artifact, root, path)
    known, back = contract.read_artifact(spark, path)
    assert known == root and back.count() == 2
    row = back.where("match_id = 'f1'").first()
    assert len(row.ranked_vetoes) == 3 and row.overall.scoreline_labels == ["2-0", "2-1", "1-2", "0-2"] and len(row.overall.greedy_veto) == 7
    assert json.loads(back.select(F.to_json("sensitivity")).first()[0])["n"] == 12
    for broken, why in (
        (artifact.withColumn("overall", F.col("overall").withField("probabilities", F.array(F.lit(1.0)))), "differ in number"),
        (artifact.withColumn("best_of", F.lit(2)), "no odd length"),
        (artifact.withColumn("team_b", F.col("team_a")), "plays itself"),
        (artifact.unionByName(artifact), "there twice"),
        (artifact.withColumn("scheduled_at", F.lit(None).cast("string")), "required field"),
    ):
        assert why in contract.breaches(broken).first().reason
        with pytest.raises(guards.IntegrityError):
            contract.write_artifact(broken, root, f"{tmp_path}/out/refused")
    assert not (tmp_path / "out/refused").exists()
    with pytest.raises(guards.IntegrityError, match="lacks"):
        contract.write_artifact(artifact, {}, path)
    artifact.unpersist()


def test_fixtures_are_left_out_with_a_reason(spark, tmp_path):
    good = {"match_id": "g", "event": "E Stage 1", "scheduled_at": "2026-05-01T10:00:00", "best_of": "Bo3", "team_a_id": "1", "team_b_id": "2"}
    cases = {
        "past": {"scheduled_at": "2026-01-01T10:00:00"}, "a team plays itself": {"team_b_id": "1"}, "a field is missing": {"event": "  "}, "no time without a zone": {"scheduled_at": "2026-05-01T10:00:00Z"},
        "no series of that length": {"best_of": "Bo7"}, "unknown team": {"team_a_id": "77"}, "no era": {"scheduled_at": "2031-05-01T10:00:00"},
    }
    rows = [good, *[{**good, **change, "match_id": why} for why, change in cases.items()], {**good, "match_id": "twice"}, {**good, "match_id": "twice"}]
    (tmp_path / "f.json").write_text(json.dumps({"fixtures": rows}))
    eras = spark.createDataFrame([("now", "2025-01-01", "2030-01-01", ["a"])], "name string, start string, until string, map_pool array<string>").withColumn("start", F.to_date("start")).withColumn("until", F.to_date("until"))
    teams = spark.createDataFrame([("1",), ("2",)], "team_id string")
    coming, out = documents.read_fixtures(spark, f"{tmp_path}/f.json", "2026-02-01 00:00:00", eras, teams)
    assert [r.match_id for r in coming.collect()] == ["g"] and coming.first().length == 3
    reasons = {r.match_id: r.reason for r in out.collect()}
    assert reasons == {**{why: why for why in cases}, "twice": "the id is there twice"}


def test_provenance(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = f"{tmp_path}/model.json"
    assert provenance.read_version(path) == provenance.UNKNOWN and provenance.changed_tables(path, {"t": df}) == ["t"]
    provenance.write_provenance(path, "v1", "abc", "2026-01-01T00:00:00", {"l2": 1.0}, {"t": df})
    assert provenance.read_version(path) == "v1@abc"
    assert provenance.changed_tables(path, {"t": df.repartition(3)}) == []
    assert provenance.changed_tables(path, {"t": df.unionByName(df.limit(1)), "u": df}) == ["t", "u"]
    with pytest.raises(ValueError):
        provenance.write_provenance(path, " ", "abc", "now", {}, {})
    (tmp_path / "bad.json").write_text("{")
    assert provenance.read_version(f"{tmp_path}/bad.json") == provenance.UNKNOWN


def test_upsert_takes_the_latest_and_breaks_ties(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "url string, at int, body string")
    new = spark.createDataFrame([("a", 2, "p"), ("a", 3, "q"), ("a", 3, "r"), ("c", 1, "z")], "url string, at int, body string")
    got = sorted(tuple(r) for r in documents.upsert(old, new.repartition(4), "url", "at").collect())
    assert got == [("a", 3, "r"), ("b", 1, "y"), ("c", 1, "z")]
