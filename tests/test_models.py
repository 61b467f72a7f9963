"""Scores, series, splits, vetoes, fitted models, documents and streams on small inputs."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import guards, names, scoring, series
from oddsloom.operators import logit, presentation, reports, splits, veto, veto_exact
from oddsloom.plans import jobs, league
from oddsloom.sources import documents
from oddsloom.streaming import streams


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_scores_by_hand(spark):
    p, y = array(0.4, 0.1, 0.2, 0.3), F.lit(1)
    r = one(spark, rps=scoring.rps(p, y), ll=scoring.log_loss(p, y), b=scoring.brier(p, y), c=scoring.side_correct(p, y))
    assert r.rps == pytest.approx(0.16 + 0.25 + 0.09)
    assert r.ll == pytest.approx(-math.log(0.1))
    assert r.b == pytest.approx(0.16 + 0.81 + 0.04 + 0.09)
    assert r.c
    with pytest.raises(Exception, match="not a probability"):
        one(spark, x=scoring.rps(array(0.4, 0.4), F.lit(0)))
    with pytest.raises(Exception, match="probability 0"):
        one(spark, x=scoring.log_loss(array(0, 1), F.lit(0)))


@pytest.mark.parametrize("best_of", [1, 3, 5, 7])
def test_scorelines_against_enumeration(spark, best_of):
    ps = [0.6, 0.5, 0.4, 0.7, 0.2, 0.55, 0.35][:best_of]
    w = series.win_threshold(best_of)
    want = dict.fromkeys(series.outcome_order(best_of), 0.0)
    for wins in itertools.product((0, 1), repeat=best_of):
        a = b = 0
        for won in wins:
            if max(a, b) < w:
                a, b = a + won, b + 1 - won
        want[a, b] += math.prod(p if x else 1 - p for p, x in zip(ps, wins, strict=True))
    got = one(spark, v=series.scorelines(array(*ps), best_of)).v
    assert got == pytest.approx(list(want.values()))
    with pytest.raises(ValueError):
        series.win_threshold(best_of + 1)


def test_splits_and_folds(spark):
    m = spark.createDataFrame([(f"m{i:02}", f"2026-01-{1 + i // 2:02}T00:00:00") for i in range(50)], "match_id string, d string").withColumn("ts", F.to_timestamp_ntz("d"))
    s = splits.chronological_split(m, 0.25).orderBy("ts", "match_id").collect()
    assert [r.split for r in s] == ["train"] * 38 + ["test"] * 12  # 12.5 goes to even
    f = splits.walk_forward_folds(m, 4, 5)
    last = f.where("fold_id = 3")
    assert last.where("role = 'validate'").count() == 10 and last.where("role = 'train'").count() == 40
    good = f.where("role = 'validate'").select("fold_id", "match_id", F.lit(1.0).alias("eta"))
    assert splits.assemble_out_of_fold(f, good).count() == 40
    with pytest.raises(guards.IntegrityError):
        splits.assemble_out_of_fold(f, good.where("match_id <> 'm45'"))
    with pytest.raises(guards.IntegrityError):
        splits.chronological_split(m.limit(20), 0.25)


def test_veto_sequences(spark):
    pool = ["d", "a", "c", "b"]
    scores = {m: [float(i * s % 3) for s in range(4)] for i, m in enumerate(pool)}
    one = spark.createDataFrame([(0, s, m, x[s]) for m, x in scores.items() for s in range(3)], "match_id long, step int, map_name string, score double")
    got = {tuple(r.sequence): r.p for r in veto_exact.enumerate_sequences(one).collect()}
    assert len(got) == 24 and sum(got.values()) == pytest.approx(1.0)
    seq, p = ("a", "d", "b", "c"), 1.0
    for i in range(3):
        rest = [m for m in pool if m not in seq[:i]]
        p *= math.exp(scores[seq[i]][i]) / sum(math.exp(scores[m][i]) for m in rest)
    assert got[seq] == pytest.approx(p)
    utilities = spark.createDataFrame([(k, s, m, x[s]) for k in range(40) for m, x in scores.items() for s in range(3)], "match_id long, step int, map_name string, score double")
    drawn = veto.sample_vetoes(utilities, 25, 3, 4).collect()
    assert drawn == veto.sample_vetoes(utilities.repartition(5), 25, 3, 4).orderBy("match_id", "draw").collect() or sorted(drawn) == sorted(veto.sample_vetoes(utilities.repartition(5), 25, 3, 4).collect())
    assert len(drawn) == 1000 and all(r.p == pytest.approx(got[tuple(r.sequence)]) for r in drawn)
    shares = {s: sum(tuple(r.sequence) == s for r in drawn) / 1000 for s in got}
    assert max(abs(shares[s] - p) for s, p in got.items()) < 0.05


def test_greedy_vetoes(spark):
    rates = [(k, b, m, float(i), float(-i) if k == "x" else 0.5) for k, b in (("x", 3), ("y", 1)) for i, m in enumerate("abcdefg")]
    df = spark.createDataFrame(rates, "match_id string, best_of int, map_name string, a double, b double")
    out = {k: [(r.step, r.side, r.action, r.map_name) for r in sorted(veto.greedy_vetoes(df).collect(), key=lambda r: r.step) if r.match_id == k] for k in "xy"}
    assert [s[3] for s in out["x"]] == list("agfbced") and out["x"][6] == (6, "", "decider", "d")
    # All rates of side B are alike in y: it bans by name.
    assert [s[3] for s in out["y"]] == list("abcdefg") and {s[2] for s in out["y"][:6]} == {"ban"}
    with pytest.raises(Exception, match="a veto needs"):
        veto.greedy_vetoes(df.where("map_name <> 'a'")).collect()
    with pytest.raises(Exception, match="no veto script"):
        veto.greedy_vetoes(df.withColumn("best_of", F.lit(7))).collect()
    played = df.limit(1).select(veto.played_maps(F.array(*[F.lit(m) for m in "abcdefg"]), F.lit(3)).alias("p")).first().p
    assert played == ["c", "d", "g"]


def test_fits_recover_known_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    u = x @ [1.0, -2.0] + rng.logistic(size=3000)
    y = (u > -1).astype(int) + (u > 1).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), 2 - int(c)) for (a, b), c in zip(x, y, strict=True)], "x1 double, x2 double, y int")
    model = logit.fit(rows, ["x1", "x2"], "y", "ordinal", logit.FitConfig(l2=0.0, max_iter=200))
    assert model.coef == pytest.approx([1.0, -2.0], abs=0.15)
    assert model.cuts == pytest.approx([-1.0, 1.0], abs=0.15)
    again = logit.LogitModel.from_json(model.to_json())
    assert again == model
    p = rows.select(logit.probabilities(model).alias("p"), "y")
    assert p.select(F.avg(scoring.log_loss(F.transform("p", lambda v: v / (F.col("p")[0] + F.col("p")[1] + F.col("p")[2])), F.col("y")))).first()[0] == pytest.approx(model.loss, abs=1e-6)
    binary = logit.fit(rows.withColumn("y", (F.col("y") < 2).cast("int")), ["x1", "x2"], "y", "binary", logit.FitConfig(l2=0.0, max_iter=40))
    assert binary.coef[0] > 0 > binary.coef[1]
    t, best, at_one, n = logit.fit_temperature(rows.select(logit.linear(model, model.coef).alias("e"), F.array(*[F.lit(c) for c in model.cuts]).alias("c"), "y"), "e", "c", "y")
    assert best <= at_one and t == pytest.approx(1.0, abs=0.1)
    assert logit.information_criteria(model)["bic"] > logit.information_criteria(model)["aic"]


def test_choice_model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(300):
        x = rng.normal(size=4)
        p = np.exp(1.5 * x) / np.exp(1.5 * x).sum()
        c = int(rng.choice(4, p=p))
        rows += [(s, float(v), i == c) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "step int, x double, chosen boolean")
    model = logit.fit_choice(df, ["x"], ["step"], "chosen", logit.FitConfig(l2=0.0, max_iter=100))
    assert model.coef[0] / model.std[0] == pytest.approx(1.5, abs=0.2)
    with pytest.raises(guards.IntegrityError):
        logit.fit_choice(df.withColumn("chosen", F.lit(True)), ["x"], ["step"], "chosen")


def test_reports(spark):
    rows = spark.createDataFrame([(i, i / 17, i % 3 == 0) for i in range(17)], "id int, p double, hit boolean")
    bins = reports.reliability_bins(rows, "p", "hit", ["id"], 5).orderBy("bin").collect()
    assert [b.n for b in bins] == [4, 4, 3, 3, 3]
    assert reports.bootstrap_sums(rows, "id", "p", 20, 1).count() == 20
    r = reports.permutation_test(spark.createDataFrame([(i, 1.0) for i in range(12)], "k int, d double"), "k", "d", 400, 5).first()
    assert r.observed == 1.0 and r.p_value < 0.05
    with pytest.raises(Exception, match="different rows"):
        reports.arms_delta(rows, rows.where("id > 0"), ["id"], "p").collect()


def test_presentation(spark, tmp_path):
    v = series.scorelines(array(0.6, 0.5, 0.4), 3)
    d = one(spark, d=presentation.derived(v, 3)).d
    assert d.p_series == pytest.approx(0.5) and d.likeliest == "2-0" and d.p_distance == pytest.approx(0.5)
    presentation.write_report({"b": 1, "a": [2]}, f"{tmp_path}/deep/r.json")
    assert json.load(open(f"{tmp_path}/deep/r.json")) == {"a": [2], "b": 1}


def document(i, score=(13, 7)):
    m = {"map_name": " the  haven", "team1_score": score[0], "team2_score": score[1], "winner": "A", "player_stats": [{"player_name": "p", "team_name": "A", "acs": 200.5, "agents": ["x", "y"]}]}
    return json.dumps(
        {"match_id": str(i), "date": "2026-01-02T03:04:05", "event_name": "Cup Stage 1", "team1": {"name": "A", "team_id": "1"}, "team2": {"name": "B", "team_id": "2"},
         "maps": [{"map_name": "split", "winner": None}, m], "veto_actions": [{"step_index": 0, "team": "A", "action": "ban", "map_name": "lotus"}], "status": "completed"}
    )


def test_documents(spark, tmp_path):
    cached = spark.createDataFrame([("1", document(1)), ("2", document(2, (12, 7))), ("3", "no json"), ("4", None)], "match_id string, data string")
    docs, aside = documents.parse(cached)
    assert [r.match_id for r in docs.select("m.match_id").collect()] == ["1"]
    assert {r.reason for r in aside.collect()} == {"illegal score", "not a match"}
    maps = documents.flatten_maps(docs).collect()
    assert [(r.map_index, r.map_name) for r in maps] == [(1, "The Haven")]
    assert json.loads(documents.flatten_players(docs).first().agents_json) == ["x", "y"]
    documents.materialize(cached, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/matches").count() == 1
    note = spark.createDataFrame([("1", "AAA ban Haven; nonsense; BBB pick the lotus; Split remains")], "match_id string, note string")
    assert [tuple(r)[1:] for r in documents.veto_steps(note).orderBy("step_index").collect()] == [(0, "AAA", "ban", "Haven"), (1, "BBB", "pick", "The Lotus"), (2, None, "decider", "Split")]
    old = spark.createDataFrame([("a", 1, "2026-01-01"), ("b", 1, "2026-01-01")], "url string, v int, fetched_at string")
    new = spark.createDataFrame([("b", 2, "2026-01-02"), ("b", 3, "2026-01-03"), ("c", 4, "2026-01-01")], "url string, v int, fetched_at string")
    assert {(r.url, r.v) for r in documents.upsert(old, new, "url", "fetched_at").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    page = spark.createDataFrame([("e", '<a href="/12/x"> <a href="/7/y"> <a href="/12/x">')], "url string, html string")
    assert [r.match_url for r in documents.event_links(page).orderBy("nth").collect()] == ["/12/x", "/7/y"]


def test_names(spark):
    r = one(spark, a=names.match_id_of(F.lit("https://x.y/123/a?b=1")), b=names.match_id_of(F.lit("https://x.y/event/1")), c=names.lenient_float(F.lit(" 12.5% ")), d=names.lenient_int(F.lit("x")), e=names.best_of(F.lit("Bo5")), f=names.best_of(F.lit("Bo4")))
    assert tuple(r) == ("123", None, 12.5, None, 5, None)


def test_eras(spark, tmp_path):
    def eras(second_start):
        path = f"{tmp_path}/{second_start}.json"
        json.dump({"region": "r", "active_era": "b", "event_urls": [], "eras": [{"name": "a", "start": "2026-01-01", "end": "2026-02-01", "map_pool": ["x"]}, {"name": "b", "start": second_start, "end": None, "map_pool": ["y", "Y "]}]}, open(path, "w"))
        return documents.read_eras(spark, path)

    rows = spark.createDataFrame([("2026-01-31T23:00:00",), ("2026-02-01T00:00:00",), ("2025-01-01T00:00:00",)], "d string").select(F.to_timestamp_ntz("d").alias("ts"))
    assert [r.era for r in documents.era_of(rows, eras("2026-02-01")).orderBy("ts").collect()] == [None, "a", "b"]
    with pytest.raises(Exception, match="out of line"):
        eras("2026-03-01").collect()


def test_train_evaluate_predict(spark, sf):
    t = league.tables(spark, sf)
    rows = league.feature_rows(t)
    d = jobs.design(rows, t, jobs.labelled(t.maps), splits.chronological_split(t.matches, check=False)).cache()
    trained = jobs.train(d, "ordinal", logit.FitConfig(max_iter=2))
    assert jobs.report(jobs.evaluate(d, trained)).first().n > 0
    fixture = spark.createDataFrame([("f1", "3", "7", "Circuit Stage 2")], "match_id string, team1_id string, team2_id string, event_name string").withColumn("ts", F.lit("1999-01-01 10:00:00").cast("timestamp_ntz"))
    pool = list(league.MAP_NAMES)
    chances = jobs.map_chances(fixture, pool, t, trained)
    s = veto_exact.enumerate_sequences(spark.createDataFrame([("f1", step, m, float(i)) for i, m in enumerate(pool) for step in range(6)], "match_id string, step int, map_name string, score double"))
    s = s.select("match_id", "p", F.array(*[F.col("sequence")[i] for i in (2, 3, 6)]).alias("played"))
    v = jobs.series_forecast(chances, s, 3).first()
    assert sum(v.probabilities) == pytest.approx(1.0) and len(v.probabilities) == 4
    d.unpersist()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"match_id": "1", "map_index": 0}\nnot json\n{"match_id": "2"}\n')
    q = streams.answer_stream(streams.json_lines(spark, f"{tmp_path}/in"), lambda b: b.select("match_id"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable(), q.stop()
    assert sorted(r.match_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2"]
    (tmp_path / "ev").mkdir()
    source = spark.readStream.schema("k string, v double, ts timestamp").json(f"{tmp_path}/ev")
    (tmp_path / "ev/a.json").write_text('{"k": "a", "v": 1, "ts": "2026-01-01T00:10:00"}\n{"k": "a", "v": 2, "ts": "2026-01-01T00:50:00"}\n{"k": "b", "v": 5, "ts": "2026-01-01T01:10:00"}\n')
    for name, df in (("counts", streams.windowed_counts(source, "ts", "k", "v")), ("state", streams.running_state(source, "k", "v"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("update").start()
        q.processAllAvailable(), q.stop()
    assert {(r.k, r.n, r.total) for r in spark.table("counts").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
    assert {(r.k, r.n, r.total) for r in spark.table("state").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
