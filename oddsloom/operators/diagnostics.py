"""Choosing strengths and questioning models: grids, cutpoints, granularity, compounding and isolated stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsloom.functions import shrink
from oddsloom.functions.asof import Level, prior_levels, prior_state, prior_totals
from oddsloom.functions.guards import positive
from oddsloom.operators import logit, reports, splits
from oddsloom.operators.features import FeatureConfig, Tables, roster_ledger
from oddsloom.operators.veto_steps import sides_before

CLIP = 1e-12
#: Accuracy and log-loss gaps from which a coarser model costs accuracy.
ACCURACY_GAP, LOSS_GAP = 0.10, 0.05


def binomial_loss(wins: Column, games: Column, p: Column) -> Column:
    """Negative log likelihood of wins out of games, the chance clipped."""
    q = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return -(wins * F.log(q) + (games - wins) * F.log(1 - q))


#: The strengths that are tried for a team's rate on a map.
WIN_GRID = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
ROUND_GRID = (*WIN_GRID, 200.0, 500.0, 1000.0)
#: Of what a rate is: won, and out of how many. Rows with a null on either side do not count.
MEASURES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "win": ("won", "1", WIN_GRID),
    "attack": ("atk_won", "atk_played", ROUND_GRID),
    "defense": ("def_won", "def_played", ROUND_GRID),
    "first_blood": ("fk", "fk + fd", ROUND_GRID),
}


def strength_rows(t: Tables, bounds: splits.FoldBounds, measure: str, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """(block, won, n, map_won, map_n, prior): each team and map of the train matches, with what was known strictly before it.

    ``prior`` is what the rate on the map is shrunk to: the team's own rate for
    wins, the team's shrunk to the league's for attack and defence rounds and to
    one half for first bloods. Test matches are not read at all: none is earlier
    than a train match.
    """
    won, of, _ = MEASURES[measure]
    ledger = roster_ledger(t) if measure == "first_blood" else t.seat_ledger()
    rows = ledger.select("match_id", "team_id", "map_name", "ts", F.expr(won).alias("won"), F.expr(of).alias("n"), bounds.block(F.col("ts"), F.col("match_id")).alias("block"))
    rows = rows.where("block is not null and won is not null and n > 0")
    q = rows.select("block", "team_id", "map_name", "ts", F.col("won").alias("here_won"), F.col("n").alias("here"))
    asked = q.where("block >= 1")
    read = prior_levels(asked, rows, "team_id", [Level(("team_id",), {"team_won": "won", "team_n": "n"}), Level(("team_id", "map_name"), {"map_won": "won", "map_n": "n"})], hot=t.hot_teams)
    if measure == "win":
        prior = shrink.rate(F.col("team_won"), F.col("team_n"), 0.5)
    elif measure == "first_blood":
        prior = shrink.beta_mean(F.col("team_won"), F.col("team_n"), F.lit(0.5), config.blood_team_k)
    else:
        read = prior_totals(read, rows, [], sums={"all_won": "won", "all_n": "n"}, base=asked)
        prior = shrink.beta_mean(F.col("team_won"), F.col("team_n"), shrink.rate(F.col("all_won"), F.col("all_n"), 0.5), config.side_team_k)
    return read.select("block", F.col("here_won").alias("won"), F.col("here").alias("n"), "map_won", "map_n", prior.alias("prior"))


def strengths_by_fold(rows: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(fold_id, grid_value, n, score, is_best): log loss by trial of every strength, over all validated rows (fold_id null) and by fold.

    One aggregate over rows, folds and grid: a task adds up the losses of all
    strengths by fold. Of equal scores the first strength is the best.
    """
    grid = [positive(k, "strength") for k in grid]
    if not grid:
        raise ValueError("no strengths to choose from")

    def loss(k: float) -> Column:
        p = (F.col("map_won") + F.lit(k) * F.col("prior")) / (F.col("map_n") + F.lit(k))
        return F.sum(binomial_loss(F.col("won"), F.col("n"), p))

    folds = rows.groupBy((F.col("block") - 1).cast("int").alias("fold_id")).agg(F.sum("n").cast("bigint").alias("n"), F.array(*[loss(k) for k in grid]).alias("losses"))
    # A row a fold from here on.
    cells = folds.select("fold_id", "n", F.posexplode("losses").alias("i", "loss"))
    sums = cells.groupingSets([[F.col("i")], [F.col("i"), F.col("fold_id")]], F.col("i"), F.col("fold_id")).agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    values = F.array(*[F.lit(k) for k in grid])
    best = F.min(F.struct("score", "i")).over(W.partitionBy("fold_id"))["i"]
    return sums.withColumn("score", F.col("loss") / F.col("n")).select("fold_id", F.element_at(values, F.col("i") + 1).alias("grid_value"), "n", "score", (F.col("i") == best).alias("is_best"))


def select_strength(t: Tables, measure: str, grid: Sequence[float] | None = None, folds: int = 5, min_block: int = 8, test_share: float = 0.15) -> DataFrame:
    """:func:`strengths_by_fold` of a measure, over walk-forward folds of the completed matches that are not held out."""
    if measure not in MEASURES:
        raise ValueError(f"no measure is named {measure!r}")
    split = splits.chronological_split(t.matches.where("status = 'completed'"), test_share, check=False)
    return strengths_by_fold(strength_rows(t, splits.fold_bounds(split, folds, min_block), measure), grid or MEASURES[measure][2])


def play_counts(maps: DataFrame, matches: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (team_id, map_name, ts) with ``n_played``: maps of that name the team played before, whatever the match's status."""
    seats = F.array("team1_id", "team2_id")
    events = maps.where("winner is not null").join(matches.select("match_id", "ts", "team1_id", "team2_id"), "match_id").select("map_name", "ts", F.explode(seats).alias("team_id"))
    return prior_state(rows, events, ["team_id", "map_name"], sums={"n_played": F.lit(1)})


def choice_features(candidates: DataFrame, ledger: DataFrame, k: float = 10.0, pool: Sequence[str] | None = None) -> DataFrame:
    """``candidates`` (match_id, team_id, opponent_id, map_name, ts) with the rates a veto is modelled by.

    own_rate and other_rate are shrunk win rates on the map; speciality is the
    own one less the unshrunk overall rate. ``pool`` as in :func:`oddsloom.operators.veto_steps.sides_before`.
    """
    out = sides_before(candidates, ledger, pool)
    overall = {s: shrink.rate(F.col(f"__{s}_w"), F.col(f"__{s}_g"), 0.5) for s in ("own", "other")}
    rate = {s: shrink.beta_mean(F.col(f"__{s}_mw"), F.col(f"__{s}_mg"), overall[s], k) for s in ("own", "other")}
    return out.select(*candidates.columns, rate["own"].alias("own_rate"), rate["other"].alias("other_rate"), (rate["own"] - overall["own"]).alias("speciality"))


def cutpoint_models(rows: DataFrame, features: list[str], label: str, classes: int, config: logit.FitConfig = logit.FitConfig()) -> list[logit.LogitModel]:
    """One binary model for each cutpoint, label above it or not."""
    return [logit.fit(rows.withColumn("__above", (F.col(label) > k).cast("int")), features, "__above", "binary", config) for k in range(classes - 1)]


def proportional_odds(ordinal: logit.LogitModel, by_cut: list[logit.LogitModel], multinomial: logit.LogitModel) -> dict:
    """Whether one coefficient does for all cutpoints: features whose sign changes, AIC and BIC, and the verdict."""
    unstable = [f for i, f in enumerate(ordinal.features) if len({m.coef[i] > 0 for m in by_cut}) > 1]
    small, large = logit.information_criteria(ordinal), logit.information_criteria(multinomial)
    violated = bool(unstable) or large["bic"] < small["bic"]
    return {"unstable": unstable, "ordinal": small, "multinomial": large, "verdict": "violated" if violated else "holds"}


def granularity_verdict(coarse: DataFrame, fine: DataFrame, key: list[str]) -> DataFrame:
    """(n, accuracy_gap, loss_gap, verdict): what a coarser model costs over the same rows (``correct``, ``log_loss``)."""
    a = coarse.select(*key, F.col("correct").cast("double").alias("a_c"), F.col("log_loss").alias("a_l"))
    b = fine.select(*key, F.col("correct").cast("double").alias("b_c"), F.col("log_loss").alias("b_l"))
    out = a.join(b, key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("b_c") - F.col("a_c")).alias("accuracy_gap"), F.avg(F.col("a_l") - F.col("b_l")).alias("loss_gap"))
    costs = (F.col("accuracy_gap") >= ACCURACY_GAP) | (F.col("loss_gap") >= LOSS_GAP)
    return out.withColumn("verdict", F.when(costs, "costs_accuracy").otherwise("no_cost"))


def compounding_pairs(scored: DataFrame) -> DataFrame:
    """(match_id, first, second): residuals of side A on the first two maps of a match."""
    a = scored.where("map_index = 0").select("match_id", F.col("residual").alias("first"))
    return a.join(scored.where("map_index = 1").select("match_id", F.col("residual").alias("second")), "match_id")


def compounding_test(pairs: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(observed, p_value): whether residuals of a match go together, by sign flips of their product."""
    return reports.permutation_test(pairs.withColumn("__d", F.col("first") * F.col("second")), "match_id", "__d", permutations, seed)


def isolated_stages(truth: DataFrame, actual: DataFrame, predicted: DataFrame, key: list[str], measure: str = "log_loss") -> DataFrame:
    """(arm, n, score): a model's score with the maps that were played and with those that were predicted, over the positions that all three hold."""
    both = truth.select(*key).join(actual.select(*key, F.col(measure).alias("actual")), key).join(predicted.select(*key, F.col(measure).alias("predicted")), key)
    cells = both.select(F.inline(F.array(*[F.struct(F.lit(x).alias("arm"), F.col(x).alias("score")) for x in ("actual", "predicted")])))
    return cells.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
