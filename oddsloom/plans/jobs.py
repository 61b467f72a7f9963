"""Whole jobs: training, evaluating and predicting over the tables of a league."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import guards, scoring, series
from oddsloom.operators import features, harness, logit, reports, seats, splits, veto
from oddsloom.session import durable


@dataclass
class Trained:
    """A map model and its temperature, with what that was fitted on: rows, and their loss at 1 and at it."""

    model: logit.LogitModel
    temperature: float = 1.0
    n_calibration: int = 0
    loss_at_one: float = float("nan")
    loss: float = float("nan")


def design(rows: DataFrame, t: features.Tables, labels: DataFrame, split: DataFrame, folds: int = 5, min_block: int = 8) -> DataFrame:
    """Feature rows with label, split and, in the train split, the chronological ``block`` of their match; rows without a label are those not finished.

    ``split`` has match_id, ts and split.
    """
    x = features.feature_matrix(rows, t)
    y = labels.select("match_id", "map_index", "outcome_ordinal")
    bounds = splits.fold_bounds(split, folds, min_block)
    blocks = split.select("match_id", "split", F.when(F.col("split") == "train", bounds.block(F.col("ts"), F.col("match_id"))).alias("block"))
    return splits.join_split(x.join(y, features.ROW), blocks)


def calibrate(rows: DataFrame, names: list[str], label: str, config: logit.FitConfig = logit.FitConfig(), block: str = "block") -> tuple[float, float, float, int]:
    """:func:`logit.fit_temperature` over out-of-fold predictions: every row is scored by a model of earlier blocks alone.

    The folds' models are fitted in the same passes. Rows of block 0 are only trained on.
    """
    folds = rows.agg(F.max(block)).first()[0]
    if not folds:
        raise guards.IntegrityError("the rows make no fold")
    models = logit.fit_folds(rows, names, label, "ordinal", F.col(block), int(folds), config)
    return logit.fit_temperature(logit.out_of_fold(rows, models, F.col(block)), "eta", "cuts", label)


def train(design_rows: DataFrame, kind: str = "ordinal", config: logit.FitConfig = logit.FitConfig()) -> Trained:
    """Fit on the train split; the ordinal model gets its temperature from out-of-fold predictions of the same split.

    A model looks better calibrated on the rows it was fitted on than it is, so
    these are never used for the temperature.
    """
    rows = design_rows.where("split = 'train'")
    label = "outcome_ordinal"
    if kind == "binary":
        rows, label = rows.withColumn("__a", (F.col("outcome_ordinal") < 2).cast("int")), "__a"
    model = logit.fit(rows, list(features.FEATURES), label, kind, config)
    if kind != "ordinal":
        return Trained(model)
    temperature, loss, at_one, n = calibrate(rows, list(features.FEATURES), label, config)
    return Trained(model, temperature, n, at_one, loss)


def evaluate(design_rows: DataFrame, trained: Trained, split: str = "test") -> DataFrame:
    """Scored rows of a split: the vector, its scores and whether the likelier side won."""
    p = logit.probabilities(trained.model, trained.temperature)
    truth = F.col("outcome_ordinal").cast("int")
    if trained.model.kind == "binary":
        truth = (F.col("outcome_ordinal") >= 2).cast("int")
    rows = design_rows.where(F.col("split") == split).withColumn("p", p).withColumn("truth", truth)
    if trained.model.kind != "binary":
        # Clipped cells may miss 1 by more than the scoring rules allow.
        rows = rows.withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)))
    p, truth = F.col("p"), F.col("truth")
    return rows.select(*features.ROW, "p", "truth", scoring.rps(p, truth).alias("rps"), scoring.log_loss(p, truth).alias("log_loss"), scoring.side_correct(p, truth).alias("correct"))


def map_model(trained: Trained) -> harness.MapModel:
    """A fitted model as a function of rows and tables; a binary one gives its two chances as regulation ones."""

    def predict(rows: DataFrame, t: features.Tables) -> DataFrame:
        p = logit.probabilities(trained.model, trained.temperature)
        out = features.feature_matrix(rows, t).select(*features.ROW, p.alias("p"))
        if trained.model.kind == "binary":
            return out.withColumn("p", F.array(F.col("p")[0], F.lit(0.0), F.lit(0.0), F.col("p")[1]))
        return out.withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)))

    return predict


#: Map models by name: what is fitted on the train split of a design, or needs no fit.
MODELS: dict[str, Callable[[DataFrame, logit.FitConfig], harness.MapModel]] = {
    "four_way_baseline": lambda design_rows, config: baseline,
    **{kind: (lambda design_rows, config, kind=kind: map_model(train(design_rows, kind, config))) for kind in ("ordinal", "multinomial", "binary")},
}


def train_replicates(design_rows: DataFrame, kind: str, replicates: int, seed: int, config: logit.FitConfig = logit.FitConfig()) -> list[logit.LogitModel]:
    """Models of bootstrap replicates of the train split's matches, all fitted in the same passes."""
    rows, label = design_rows.where("split = 'train'"), "outcome_ordinal"
    if kind == "binary":
        rows, label = rows.withColumn("__a", (F.col("outcome_ordinal") < 2).cast("int")), "__a"
    return logit.fit_replicates(rows, list(features.FEATURES), label, kind, replicates, seed, "match_id", config)


def report(scored: DataFrame) -> DataFrame:
    """One row: count and mean scores."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("rps").alias("rps"), F.avg("log_loss").alias("log_loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def map_chances(fixtures: DataFrame, pool: list[str], t: features.Tables, trained: Trained, replicates: Sequence[logit.LogitModel] = (), level: float = 0.9) -> DataFrame:
    """(match_id, map_name, p, low, high, sides): a vector for each fixture and map of the pool, each made once, and its bands over the replicates.

    Fixtures have match_id, team1_id, team2_id, ts and event_name; their own
    matches are added to the tables for what depends on the event. Bands hold
    the model's own chance too, so that they lie around it; without replicates
    they are null, as is ``sides``, side A's chance by every replicate.
    """
    rows = fixtures.withColumn("map_name", F.explode(F.array(*[F.lit(m) for m in sorted(pool)])))
    index = F.array_position(F.array(*[F.lit(m) for m in sorted(pool)]), F.col("map_name")).cast("int") - 1
    rows = rows.withColumn("map_index", index).select("match_id", "map_index", "map_name", "ts", "team1_id", "team2_id")
    known = t.matches.unionByName(fixtures.withColumn("status", F.lit("upcoming")).select([c for c in t.matches.columns if c in fixtures.columns or c == "status"]), allowMissingColumns=True)
    x = features.feature_matrix(rows, features.Tables(known, t.maps, t.players))
    p = logit.probabilities(trained.model, trained.temperature)
    rows = rows.join(x, features.ROW)
    if not replicates:
        return rows.select("match_id", "map_name", p.alias("p"), *[F.lit(None).cast("array<double>").alias(c) for c in ("low", "high", "sides")])
    rows = durable(rows.select("match_id", "map_name", p.alias("p"), *replicates[0].features))
    bands = logit.replicate_bands(rows, ["match_id", "map_name"], list(replicates), level)
    both = rows.select("match_id", "map_name", "p").join(bands, ["match_id", "map_name"])
    return both.select("match_id", "map_name", "p", F.zip_with("low", "p", lambda a, b: F.least(a, b)).alias("low"), F.zip_with("high", "p", lambda a, b: F.greatest(a, b)).alias("high"), "sides")


def series_forecast(chances: DataFrame, sequences: DataFrame, best_of: int) -> DataFrame:
    """(match_id, probabilities): scorelines averaged over veto sequences, by their probability.

    ``sequences`` has match_id, p and played (the maps in order). Clipped map
    cells are taken as they are: side A's chance is the sum of its cells.
    """
    side = F.map_from_entries(F.collect_list(F.struct("map_name", scoring.side_a(F.col("p")).alias("a")))).alias("side")
    rows = sequences.select("match_id", F.col("p").alias("w"), "played").join(chances.groupBy("match_id").agg(side), "match_id")
    vector = series.scorelines(F.transform("played", lambda m: F.element_at("side", m)), best_of)
    return veto.mixture(rows.select("match_id", "w", vector.alias("v")), "match_id", "w", "v")


def baseline(rows: DataFrame, t: features.Tables) -> DataFrame:
    """(match_id, map_index, p): the four-way baseline from shrunk win rates and the league's overtime rate."""
    ledger = t.seat_ledger()
    # A team is asked once a match, and its maps of one time are one event.
    own = ledger.groupBy("team_id", "ts").agg(F.sum("won").alias("won"), F.count(F.lit(1)).alias("n"))
    read = features.prior_state(features.sides_by_match(rows, t), own, ["team_id"], sums={"w": "won", "g": "n"}, hot=t.hot_teams)
    read = features.prior_totals(read, ledger.where("seat = 1"), [], sums={"o": "ot", "n": F.lit(1)}, base=rows)
    rate = (F.col("w") + 5.0) / (F.col("g") + 10.0)
    met = read.select("match_id", "indexes", "side", rate.alias("rate"), "o", "n").repartition("match_id").select("match_id", F.explode("indexes").alias("map_index"), "side", "rate", "o", "n")
    both = met.groupBy(*features.ROW).agg(
        F.max(F.when(F.col("side") == 1, F.col("rate"))).alias("a"), F.max(F.when(F.col("side") == 2, F.col("rate"))).alias("b"), F.max(F.coalesce(F.try_divide(F.col("o").cast("double"), F.col("n").cast("double")), F.lit(0.0))).alias("ot")
    )
    return both.select(*features.ROW, logit.four_way_baseline(F.col("a"), F.col("b"), F.col("ot")).alias("p"))


def compare_arms(a: DataFrame, b: DataFrame, measure: str = "log_loss") -> DataFrame:
    """Difference of two arms over the same maps."""
    return reports.arms_delta(a, b, features.ROW, measure)


def labelled(maps: DataFrame) -> DataFrame:
    """Outcome labels of finished maps."""
    return seats.outcome_labels(maps.where("winner is not null"))
