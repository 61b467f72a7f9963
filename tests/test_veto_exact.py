"""Exact vetoes by match against all orders, sampled vetoes and plain series."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.operators import veto, veto_exact

POOL = list("abcdefg")
SCHEMA = "match_id string, step int, map_name string, score double"


def utilities(spark, matches, seed=0, pool=POOL, spread=2.0):
    rng = random.Random(seed)
    rows = [(m, s, x, rng.gauss(0, spread)) for m in matches for s in range(len(pool) - 1) for x in pool]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), {(m, s, x): v for m, s, x, v in rows}


def all_orders(score, match, pool=POOL):
    """{order: chance} by plain enumeration."""
    out = {}
    for order in itertools.permutations(pool):
        p, left = 1.0, set(pool)
        for s, x in enumerate(order[:-1]):
            p *= math.exp(score[match, s, x]) / sum(math.exp(score[match, s, y]) for y in left)
            left.remove(x)
        out[order] = p
    return out


def scoreline(played, a, best_of):
    """{(wins, losses): chance} of the maps in order, until one side has enough."""
    state, need = {(0, 0): 1.0}, (best_of + 1) // 2
    for m in played:
        after = {}
        for (x, y), p in state.items():
            steps = [((x, y), 1.0)] if need in (x, y) else [((x + 1, y), a[m]), ((x, y + 1), 1 - a[m])]
            for k, q in steps:
                after[k] = after.get(k, 0) + p * q
        state = after
    return state


def test_states_marginals_and_orders(spark):
    u, score = utilities(spark, ["m", "n"])
    for match in ("m", "n"):
        orders = all_orders(score, match)
        assert sum(orders.values()) == pytest.approx(1)
        got = {tuple(r.sequence): r.p for r in veto_exact.enumerate_sequences(u).where(F.col("match_id") == match).collect()}
        assert got == pytest.approx(orders)
        states = {(r.step, tuple(r.remaining)): r.p for r in veto_exact.state_chances(u).where(F.col("match_id") == match).collect()}
        assert len(states) == 127
        marginals = {(r.step, r.map_name): r.p for r in veto_exact.step_marginals(u).where(F.col("match_id") == match).collect()}
        for step in range(7):
            assert sum(p for (s, _), p in states.items() if s == step) == pytest.approx(1)
            assert sum(p for (s, _), p in marginals.items() if s == step) == pytest.approx(1)
            want_left, want_map = {}, {}
            for order, p in orders.items():
                left = tuple(sorted(order[step:]))
                want_left[left] = want_left.get(left, 0) + p
                want_map[order[step]] = want_map.get(order[step], 0) + p
            assert {k: p for (s, k), p in states.items() if s == step} == pytest.approx(want_left)
            assert {k: p for (s, k), p in marginals.items() if s == step} == pytest.approx(want_map)


def test_likeliest_orders_are_found_first(spark):
    u, score = utilities(spark, ["m", "n"], seed=3)
    got = {}
    for r in veto_exact.top_sequences(u, 40).collect():
        got.setdefault(r.match_id, {})[r["rank"]] = (tuple(r.sequence), r.p)
    for match in ("m", "n"):
        want = sorted(all_orders(score, match).items(), key=lambda x: (-x[1], x[0]))[:40]
        assert [got[match][i + 1][0] for i in range(40)] == [o for o, _ in want]
        assert [got[match][i + 1][1] for i in range(40)] == pytest.approx([p for _, p in want])
    flat = u.withColumn("score", F.lit(1.0))
    rows = {r["rank"]: r.sequence for r in veto_exact.top_sequences(flat.where("match_id = 'm'"), 30).collect()}
    assert [tuple(rows[i + 1]) for i in range(30)] == list(itertools.islice(itertools.permutations(POOL), 30))
    small, _ = utilities(spark, ["x"], pool=list("pq"))
    assert veto_exact.top_sequences(small, 9).count() == 2
    assert veto_exact.top_sequences(u.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        veto_exact.top_sequences(u, 0)


def test_sampled_vetoes_have_their_exact_chances(spark):
    u, score = utilities(spark, ["m"], seed=5)
    orders = all_orders(score, "m")
    drawn = veto.sample_vetoes(u, 400, 3).collect()
    assert [r.p for r in drawn] == pytest.approx([orders[tuple(r.sequence)] for r in drawn])
    first = {r.map_name: r.p for r in veto_exact.step_marginals(u).where("step = 0").collect()}
    top = max(first, key=first.get)
    assert sum(r.sequence[0] == top for r in drawn) / 400 == pytest.approx(first[top], abs=0.1)


@pytest.mark.parametrize("best_of", [1, 3, 5])
def test_series_and_leverage_over_all_vetoes(spark, best_of):
    matches = ["m", "n"]
    u, score = utilities(spark, matches, seed=best_of)
    rng = random.Random(best_of)
    a = {(m, x): rng.random() for m in matches for x in POOL}
    wins = spark.createDataFrame([(m, x, p) for (m, x), p in a.items()], "match_id string, map_name string, a double")
    lengths = spark.createDataFrame([(m, best_of) for m in matches], "match_id string, best_of int")
    order = [(w, l) for w, l in veto_exact.series.outcome_order(best_of)]
    for r in veto_exact.exact_series(u, wins, lengths).collect():
        cells, mass, won, all_won = dict.fromkeys(order, 0.0), dict.fromkeys(POOL, 0.0), dict.fromkeys(POOL, 0.0), 0.0
        for seq, p in all_orders(score, r.match_id).items():
            played = [x for x, action in zip(seq, veto.SCRIPTS[best_of], strict=True) if action != "ban"]
            line = scoreline(played, {x: a[r.match_id, x] for x in POOL}, best_of)
            for k, q in line.items():
                cells[k] += p * q
            own = sum(q for (x, y), q in line.items() if x > y)
            all_won += p * own
            for x in played:
                mass[x] += p
                won[x] += p * own
        assert r.probabilities == pytest.approx([cells[k] for k in order]) and sum(r.probabilities) == pytest.approx(1)
        assert {x.map_name: x.p_played for x in r.leverage} == pytest.approx(mass)
        assert {x.map_name: x.swing for x in r.leverage} == pytest.approx({x: won[x] / mass[x] - (all_won - won[x]) / (1 - mass[x]) for x in POOL})


def test_odd_scores_fail(spark):
    u, _ = utilities(spark, ["m"])
    wins = spark.createDataFrame([("m", x, 0.5) for x in POOL], "match_id string, map_name string, a double")
    three = spark.createDataFrame([("m", 3)], "match_id string, best_of int")
    for bad in (u.where("step < 5"), u.unionByName(u.limit(1)), u.where("not (step = 2 and map_name = 'c')"), u.withColumn("score", F.when(F.col("step") > 0, F.col("score"))), u.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(Exception, match="one score of each map at each step"):
            veto_exact.state_chances(bad).collect()
    for w, n in ((wins.where("map_name <> 'd'"), three), (wins.withColumn("a", F.lit(1.5)), three), (wins, three.withColumn("best_of", F.lit(2)))):
        with pytest.raises(Exception, match="without a script"):
            veto_exact.exact_series(u, w, n).collect()
    assert veto_exact.exact_series(u.limit(0), wins, three).count() == 0


def test_bands_over_replicates_are_percentiles_of_exact_series(spark):
    matches, n = ["m", "n", "o"], 6
    u, _ = utilities(spark, matches, seed=9)
    rng = random.Random(9)
    a = {(m, x): [rng.random() for _ in range(n if m != "o" else 2)] for m in matches for x in POOL}
    lengths = spark.createDataFrame([("m", 3), ("n", 5), ("o", 3)], "match_id string, best_of int")
    wins = spark.createDataFrame([(m, x, p) for (m, x), p in a.items()], "match_id string, map_name string, a array<double>")
    got = {r.match_id: r for r in veto_exact.series_bands(u, wins, lengths, 0.8).collect()}
    for m in matches:
        own = []
        for r in range(len(a[m, "a"])):
            one = spark.createDataFrame([(m, x, a[m, x][r]) for x in POOL], "match_id string, map_name string, a double")
            p = veto_exact.exact_series(u.where(F.col("match_id") == m), one, lengths).first().probabilities
            own.append(sum(p[: len(p) // 2]))
        low, high = np.percentile(own, [10, 90])
        assert (got[m].n, got[m].mean, got[m].low, got[m].high) == (len(own), pytest.approx(np.mean(own)), pytest.approx(low), pytest.approx(high))
    for bad in (wins.where("map_name <> 'c'"), wins.withColumn("a", F.when(F.col("map_name") == "a", F.slice("a", 1, 1)).otherwise(F.col("a"))), wins.withColumn("a", F.array(F.lit(2.0)))):
        with pytest.raises(Exception, match="without a chance"):
            veto_exact.series_bands(u, bad, lengths).collect()
