"""Evaluation of any map model over held-out maps, and walk-forward fits.

A map model is a function of rows (match_id, map_index, map_name, ts, both
teams) and the tables, which gives (match_id, map_index, p): a vector of chances
for each row, from what was known before the row's time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import scoring
from oddsloom.operators.features import ROW, Tables
from oddsloom.operators.splits import join_split

MapModel = Callable[[DataFrame, Tables], DataFrame]
#: The four outcomes in order.
LABELS = ("A_regulation", "A_OT", "B_OT", "B_regulation")


def held_out_maps(t: Tables, labels: DataFrame, split: DataFrame, which: str = "test") -> DataFrame:
    """Labelled maps of one split with the match's time and teams; a map whose match has no split fails.

    Labels may carry their ``map_name``; then maps are not joined. Matches meet
    their split first, so that maps are met by those of the one split alone.
    """
    own = t.matches.select("match_id", "ts", "team1_id", "team2_id")
    rows = labels.select(*ROW, "outcome_ordinal", *[c for c in ("map_name",) if c in labels.columns])
    if "map_name" not in labels.columns:
        rows = rows.join(t.maps.select(*ROW, "map_name"), ROW)
    without = own.join(split, "match_id", "left_anti")
    if not without.isEmpty():
        # Matches without maps may do without a split.
        join_split(rows.join(without, "match_id"), split)
    asked = own.join(split.where(F.col("split") == which).select("match_id"), "match_id")
    return rows.join(asked, "match_id").select("match_id", "map_index", "outcome_ordinal", "map_name", "ts", "team1_id", "team2_id")


def score_held_out(model: MapModel, held_out: DataFrame, t: Tables) -> DataFrame:
    """(match_id, map_index, p, truth, rps, log_loss, correct) of every held-out map; a map that the model leaves out fails the job."""
    found = model(held_out.drop("outcome_ordinal"), t).select(*ROW, "p")
    rows = held_out.select(*ROW, F.col("outcome_ordinal").cast("int").alias("truth")).join(found, ROW, "left")
    p = F.coalesce("p", F.raise_error(F.concat(F.lit("no prediction for "), F.concat_ws("/", *[F.col(c).cast("string") for c in ROW]))).cast("array<double>"))
    rows = rows.withColumn("p", p)
    p, truth = F.col("p"), F.col("truth")
    return rows.select(*ROW, "p", "truth", scoring.rps(p, truth).alias("rps"), scoring.log_loss(p, truth).alias("log_loss"), scoring.side_correct(p, truth).alias("correct"))


def _sums(scored: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row: the count and all means that the reports are made from."""
    p, y = F.col("p"), F.col("truth")
    return scored.agg(
        F.count(F.lit(1)).alias("n_eval"), F.avg("rps").alias("mean_rps"), F.avg("log_loss").alias("mean_log_loss"), F.avg(F.col("correct").cast("double")).alias("side_accuracy"),
        *[F.avg(p[i]).alias(f"predicted{i}") for i in range(len(labels))], *[F.avg((y == i).cast("double")).alias(f"observed{i}") for i in range(len(labels))],
    )


def calibration(scored: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(category, predicted, observed, gap): the mean chance of each outcome against its share."""
    cells = [F.struct(F.lit(name).alias("category"), F.col(f"predicted{i}").alias("predicted"), F.col(f"observed{i}").alias("observed")) for i, name in enumerate(labels)]
    return _sums(scored, labels).select(F.inline(F.array(*cells))).withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def evaluation_report(scored: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row: count, mean scores, the outcome of largest gap (the first of equal ones), and overtime predicted and observed."""
    s = _sums(scored, labels)
    gaps = [F.abs(F.col(f"predicted{i}") - F.col(f"observed{i}")) for i in range(len(labels))]
    worst = F.array_position(F.array(*gaps), F.array_max(F.array(*gaps))).cast("int")
    out = s.select(
        "n_eval", "mean_rps", "mean_log_loss", "side_accuracy", F.element_at(F.array(*[F.lit(x) for x in labels]), worst).alias("worst_category"),
        (F.col("predicted1") + F.col("predicted2")).alias("ot_predicted"), (F.col("observed1") + F.col("observed2")).alias("ot_observed"),
    )
    return out.withColumn("ot_gap", F.abs(F.col("ot_predicted") - F.col("ot_observed")))


def compare_models(models: dict[str, MapModel], held_out: DataFrame, t: Tables) -> DataFrame:
    """The evaluation report of each model over the same maps, with its name."""
    out = None
    for name, model in models.items():
        own = evaluation_report(score_held_out(model, held_out, t)).select(F.lit(name).alias("model"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def walk_forward(design: DataFrame, folds: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], key: str = "match_id") -> DataFrame:
    """Out-of-fold rows: each fold's ``fit`` sees its train rows and predicts its validation rows.

    ``folds`` has (fold_id, key, role). ``fit`` gives a function of rows that
    adds its columns; results carry ``fold_id``. The number of folds is that of
    models to be fitted, so it is read to the driver.
    """
    ids = sorted(r[0] for r in folds.select("fold_id").distinct().collect())
    out = None
    for i in ids:
        own = folds.where(F.col("fold_id") == i)
        predict = fit(design.join(own.where("role = 'train'").select(key), key, "left_semi"))
        found = predict(design.join(own.where("role = 'validate'").select(key), key, "left_semi")).withColumn("fold_id", F.lit(i))
        out = found if out is None else out.unionByName(found)
    return out
