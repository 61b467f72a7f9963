"""What keeps jobs within their limits as tables grow: shuffles of a plan, sizes of tasks, and the same results as the plain way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import asof
from oddsloom.operators import features, harness, logit, seats, splits, veto, veto_exact, veto_steps
from oddsloom.plans import jobs, league, queries
from oddsloom.session import stored
from oddsloom.streaming import streams


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_vetoes_and_the_ledger_are_made_without_a_shuffle(spark, sf):
    t = league.tables(spark, sf)
    assert shuffles(league.vetoes(spark, sf)) == 0
    assert shuffles(t.seat_ledger()) == 0
    assert shuffles(features.roster_ledger(t)) == 0


def test_team_and_map_totals_take_one_shuffle(spark, sf):
    t = league.tables(spark, sf)
    for f in (features.map_win_rate_diff, features.first_blood_diff, features.signed_margin_diff):
        # The second brings the two sides of a row together.
        assert shuffles(f(league.feature_rows(t), t)) <= 2


def test_reads_by_levels_are_dealt_by_the_number_of_queries(spark, sf, monkeypatch):
    t = league.tables(spark, sf, False)
    q, levels = features.sides(league.feature_rows(t)), [asof.Level(("team_id",), {"games": F.lit(1)})]
    want = asof.prior_levels(q, t.seat_ledger(), "team_id", levels)
    monkeypatch.setattr(asof, "QUERIES_A_TASK", 500)
    got = asof.prior_levels(q, t.seat_ledger(), "team_id", levels)
    assert got.rdd.getNumPartitions() == -(-q.count() // 500) > 4
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_sides_and_stage_of_the_matrix_meet_in_one_shuffle(spark, sf):
    t = league.tables(spark, sf)
    plan = features.feature_matrix(league.feature_rows(t), t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(match_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(match_id" in line and "map_index" in line]


def test_rosters_are_the_same_from_nested_and_from_flat_rows(spark, sf):
    t = league.tables(spark, sf)
    flat = features.Tables(t.matches, t.maps, t.players)
    cols = ["match_id", "map_index", "team_id", F.round("acs", 9), F.round("player_rating", 9), "players", "fk", "fd"]
    one, two = (features.roster_ledger(x).select(*cols) for x in (t, flat))
    assert one.count() == two.count() > 0 and one.exceptAll(two).isEmpty()


def test_both_sides_rates_are_those_of_single_reads(spark, sf):
    t = league.tables(spark, sf, False)
    rows = veto_steps.candidates(league.vetoes(spark, sf), t.matches, league.MAP_NAMES).where("cast(match_id as int) % 3 = 0")
    want = rows
    for side, key in (("own", "team_id"), ("other", "opponent_id")):
        events = t.seat_ledger().select(F.col("team_id").alias(key), "map_name", "ts", "won")
        want = asof.prior_state(want, events, [key], sums={f"__{side}_w": "won", f"__{side}_g": F.lit(1)}, base=rows)
        want = asof.prior_state(want, events, [key, "map_name"], sums={f"__{side}_mw": "won", f"__{side}_mg": F.lit(1)}, base=rows)
    for pool in (league.MAP_NAMES, None):
        got = veto_steps.sides_before(rows, t.seat_ledger(), pool).select(want.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    with pytest.raises(Exception, match="beyond the pool"):
        veto_steps.sides_before(rows, t.seat_ledger(), league.MAP_NAMES[:3]).collect()
    with pytest.raises(Exception, match="without a match"):
        veto_steps.sides_before(rows.withColumn("match_id", F.lit(None).cast("string")), t.seat_ledger(), league.MAP_NAMES).collect()


def test_candidates_are_dealt_to_tasks_by_the_number_of_vetoes(spark, sf, monkeypatch):
    monkeypatch.setattr(veto_steps, "MATCHES_A_TASK", 30)
    m = league.matches(spark, sf)
    rows = veto_steps.candidates(league.vetoes(spark, sf), m, league.MAP_NAMES)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert m.count() > 1000 and max(sizes) < 30 * 27 * 3


def test_choices_of_steps_of_different_sizes_are_fitted_in_slices(spark):
    rng = np.random.default_rng(5)
    rows, want = [], np.zeros(2)
    for step in range(60):
        n = 2 + step % 4
        xs = rng.normal(size=(n, 2))
        first = int(rng.integers(n))
        rows += [(step, float(x[0]), float(x[1]), i == first) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "step int, a double, b double, chosen boolean").repartition(3)
    got = logit.fit_choice(df, ["a", "b"], ["step"], "chosen", logit.FitConfig(grad_tol=1e-9))
    flat = np.array([r[1:3] for r in rows])
    z = (flat - flat.mean(axis=0)) / flat.std(axis=0)
    for _ in range(500):
        g = np.zeros(2)
        for step in range(60):
            own = np.array([i for i, r in enumerate(rows) if r[0] == step])
            q = np.exp(z[own] @ want)
            q /= q.sum()
            g += z[own].T @ (q - np.array([rows[i][3] for i in own], float))
        want -= 0.5 * (g / 60 + want)
    assert got.converged and np.allclose(got.coef, want, atol=1e-6)


def test_rates_by_match_are_those_of_candidates(spark, sf):
    """A row a match holds what its candidates' rows do; no window or shuffle is by step, and a repeated match fails."""
    t, pool = league.tables(spark, sf, False), league.MAP_NAMES
    m = t.matches.where("cast(match_id as int) % 40 = 0")
    whole = veto_steps.checked_steps(league.vetoes_by_match(spark, sf).join(m.select("match_id"), "match_id", "left_semi"), pool)
    rated = stored(veto_steps.match_rates(whole, t, pool))
    got = veto_steps.rated_left(rated).select(*veto_steps.STEP, "action", F.col("map_name").alias("taken"), F.inline("left")).withColumn("chosen", F.col("taken") == F.col("map_name"))
    flat = veto_steps.candidates(league.vetoes(spark, sf).join(m.select("match_id"), "match_id", "left_semi"), m, pool)
    rows = stored(veto_steps.with_rates(flat, t, pool=pool))
    columns = [*veto_steps.STEP, "action", "map_name", "chosen", *[F.round(c, 9).alias(c) for c in veto_steps.CHOICE_FEATURES]]
    assert rows.count() == got.count() and got.select(columns).exceptAll(rows.select(columns)).isEmpty()
    together = veto_steps.choice_models(rated, ("ban", "pick"), pool)
    alone = veto_steps.choice_model(rows, "pick")
    assert together["pick"].n == alone.n and np.allclose(together["pick"].coef, alone.coef, atol=1e-5) and np.isclose(together["pick"].loss, alone.loss)
    for weights, p in ((lambda c: F.lit(1.0), veto_steps.uniform(rows)), (lambda c: F.exp(F.when(F.col("action") == "ban", -c["own_rate"]).otherwise(c["own_rate"])), veto_steps.by_greed(rows))):
        judged = veto_steps.score_left(veto_steps.rated_left(rated), weights, 9)
        assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()
        want = veto_steps.score_steps(p.withColumn("p", F.round("p", 9)))
        names = [*veto_steps.STEP, "map_name", F.round("p", 8).alias("p"), "rank", "top1", "top3"]
        assert judged.select(names).exceptAll(want.select(names)).isEmpty()
    with pytest.raises(Exception, match="a repeated match"):
        veto_steps.match_rates(whole.unionByName(whole.limit(1)), t, pool).collect()


def test_a_team_is_asked_once_a_match(spark, sf, monkeypatch):
    """Features of a team alone read two rows a match, whether its maps come as rows or are the tables' own, and with hot teams too."""
    t = league.tables(spark, sf)
    flat = stored(t.rows)
    assert shuffles(features.sides_by_match(t.rows, t)) == 0
    assert features.sides_by_match(flat, t).count() == features.sides_by_match(t.rows, t).count() == 2 * flat.select("match_id").distinct().count() < 2 * flat.count()
    want = {f: stored(f(t.rows, t)) for f in (features.roster_decay_diff, features.form_diffs, features.elo_differential)}
    assert all(w.count() == flat.count() and f(flat, t).exceptAll(w).isEmpty() for f, w in want.items())
    monkeypatch.setattr(asof, "HOT_ROWS", 20)
    hot = league.tables(spark, sf)
    assert hot.hot_teams is not None
    assert all(f(hot.rows, hot).exceptAll(w).isEmpty() for f, w in want.items())


def test_team_and_map_sums_take_two_rows_a_match(spark, sf, tmp_path, monkeypatch):
    """A side of a match is one row that asks and is history; repeated orders, null teams and times, hot teams and many names give the same as rows of maps."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    odd = F.when(F.col("o_orderkey") % 50 == 3, None)
    orders = orders.unionByName(orders.where("o_orderkey % 40 = 1").withColumn("o_custkey", F.col("o_custkey") + 1)).withColumn("o_custkey", F.coalesce(odd, F.when(F.col("o_orderkey") % 50 != 3, F.col("o_custkey"))))
    orders = orders.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 60 != 7, F.date_trunc("year", "o_orderdate").cast(orders.schema["o_orderdate"].dataType)))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    by_match = (features.map_win_rate_diff, features.attack_side_win_rate_diff, features.signed_margin_diff)
    t = league.tables(spark, str(tmp_path), False)
    dealt = features._sums_by_match(t, lambda x: {"wins": x("won")})
    assert dealt.count() == 2 * t.by_match.count() < 2 * t.rows.count() and shuffles(dealt) == 1
    flat = stored(t.rows)

    def rounded(df):
        return df.select("match_id", "map_index", F.round(df.columns[-1], 9).alias("x"))

    want = {f: stored(rounded(f(flat, t))) for f in by_match}
    with monkeypatch.context() as m:
        m.setattr(asof, "QUERIES_A_TASK", 10**9)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            got = {f: stored(rounded(f(t.rows, t))) for f in by_match}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for f in by_match:
        assert got[f].count() == want[f].count() > 0 and got[f].exceptAll(want[f]).isEmpty()
    monkeypatch.setattr(features, "POOL_NAMES", 3)
    few = league.tables(spark, str(tmp_path), False)
    assert few.pool is None and rounded(by_match[0](few.rows, few)).exceptAll(want[by_match[0]]).isEmpty()


def test_vetoes_of_single_keys_are_scored_in_their_rows(spark, sf):
    """A key's scores are made in its row: only keys are dealt; marginals and draws are those of scores gathered from rows, and repeated keys go by these."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").limit(60)
    one = queries._utilities(rows, "c_custkey")
    assert one.columns == ["match_id", "maps", "scores"] and "Aggregate" not in veto_exact.gathered(one)._jdf.queryExecution().executedPlan().toString()
    cells = one.select("match_id", "maps", F.posexplode("scores").alias("at", "score"))
    flat = cells.select("match_id", (F.col("at") / 7).cast("int").alias("step"), F.expr("maps[at % 7]").alias("map_name"), "score").repartition(5)
    for f in (veto_exact.step_marginals, lambda u: veto.sample_vetoes(u, 3, 4)):
        got, want = stored(f(one)), stored(f(flat))
        assert got.count() == want.count() > 60 and got.exceptAll(want).isEmpty()
    twice = queries._utilities(rows.unionByName(rows.limit(1)), "c_custkey")
    assert "scores" not in twice.columns and twice.count() == 61 * 42
    with pytest.raises(Exception, match="one score of each map at each step"):
        veto_exact.step_marginals(twice).collect()
    for bad in (one.withColumn("scores", F.slice("scores", 1, 41)), one.withColumn("scores", F.transform("scores", lambda x, i: F.when(i != 3, x))), one.withColumn("maps", F.reverse("maps"))):
        with pytest.raises(Exception, match="one score of each map at each step"):
            veto_exact.step_marginals(bad).collect()


def test_held_out_maps_and_fold_rows_are_joined_once(spark, sf, monkeypatch):
    """Held-out maps are met by test matches alone, labels with names without a second join, and what passes read again is stored."""
    t = league.tables(spark, sf, False)
    split = stored(splits.chronological_split(t.matches, check=False))
    named, plain = (harness.held_out_maps(t, seats.outcome_labels(t.maps, *keep), split) for keep in (("map_name",), ()))
    whole = seats.outcome_labels(t.maps).select(*features.ROW, "outcome_ordinal").join(t.maps.select(*features.ROW, "map_name"), features.ROW).join(t.matches.select("match_id", "ts", "team1_id", "team2_id"), "match_id")
    want = stored(whole.join(split.where("split = 'test'").select("match_id"), "match_id"))
    for got in (named, plain):
        assert got.count() == want.count() > 0 and got.select(want.columns).exceptAll(want).isEmpty()
    assert named._jdf.queryExecution().optimizedPlan().toString().count("Join") == plain._jdf.queryExecution().optimizedPlan().toString().count("Join") - 1
    with pytest.raises(Exception, match="no split for"):
        harness.held_out_maps(t, seats.outcome_labels(t.maps), split.where("cast(match_id as int) % 7 != 0"))
    # Sides are asked once a match, in any tables and for repeated rows as for single ones.
    asked = named.drop("outcome_ordinal")
    got = jobs.baseline(asked, t)
    assert got.count() == asked.count() and jobs.baseline(asked.unionByName(asked), t).exceptAll(got).isEmpty()
    plan = {}
    monkeypatch.setattr(jobs, "calibrate", lambda rows, *a: plan.update(rows=rows) or (1.0, 1.0, 1.0, 1))
    queries.out_of_fold_temperature(spark, sf)
    assert "Join" not in plan["rows"]._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_written_out_a_few_matches_at_a_time(spark):
    names = ["a", "b", "c", "d", "e", "f", "g"]
    rows = [(k, s, m, float((k * 7 + s * 3 + i * i) % 5)) for k in range(20) for s in range(6) for i, m in enumerate(names)]
    df = spark.createDataFrame(rows, "match_id long, step int, map_name string, score double").coalesce(1)
    out = veto_exact.enumerate_sequences(df)
    sizes = out.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert out.count() == 20 * 5040 and max(r.n for r in sizes.collect()) <= veto_exact.ORDERS_A_BATCH
    one = {tuple(r.sequence): r.p for r in out.where("match_id = 3").collect()}
    score = {(s, m): x for k, s, m, x in rows if k == 3}
    order, p = ("c", "a", "g", "b", "f", "e", "d"), 1.0
    for s, m in enumerate(order[:-1]):
        p *= np.exp(score[s, m]) / sum(np.exp(score[s, n]) for n in order[s:])
    assert len(one) == 5040 and np.isclose(one[order], p) and np.isclose(sum(one.values()), 1.0)


def test_many_files_of_questions_are_few_batches(spark, tmp_path):
    asked = spark.range(50).selectExpr("to_json(struct(cast(id as string) match_id, 1 seed)) as value")
    asked.repartition(50).write.text(f"{tmp_path}/in")
    files = streams.files_for_batches(spark, f"{tmp_path}/in", 4)
    seen = []
    questions = streams.json_lines(spark, f"{tmp_path}/in", "match_id STRING, seed BIGINT", files)
    streams.answer_all(questions, lambda b: (seen.append(1), b)[1], f"{tmp_path}/out", f"{tmp_path}/state")
    assert len(seen) <= 4 and spark.read.parquet(f"{tmp_path}/out").count() == 50
