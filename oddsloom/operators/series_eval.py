"""Series of maps: the flat baseline, scores of scoreline vectors, and how often series are swept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsloom.functions import series, shrink
from oddsloom.functions.asof import prior_state
from oddsloom.operators.features import Tables
from oddsloom.operators.reports import percentile_band

#: Lengths of series that are played.
LENGTHS = (1, 3, 5)


def by_length(best_of: Column, make: Callable[[int], Column], otherwise: Column) -> Column:
    """The value of ``make(length)`` for the row's length."""
    out = otherwise
    for n in LENGTHS:
        out = F.when(best_of == n, make(n)).otherwise(out)
    return out


def flat_vector(p: Column, best_of: Column) -> Column:
    """Scoreline chances if every map is won with the same chance; null for a length that is not played."""
    return by_length(best_of, lambda n: series.scorelines(F.array_repeat(p, n), n), F.lit(None).cast("array<double>"))


def flat_series(rows: DataFrame, t: Tables) -> DataFrame:
    """``rows`` (match_id, ts, best_of, team1_id, team2_id) with ``p_map`` and ``probabilities``.

    Both sides' overall win rates before the row's time (0.5 without maps) give
    side A's chance of any map: its share of the two, or one half if both are 0.
    """
    ledger, hot = t.seat_ledger(), t.hot_teams
    named = {i: hot and hot.withColumnRenamed("team_id", f"team{i}_id") for i in (1, 2)}
    one = prior_state(rows, ledger.withColumnRenamed("team_id", "team1_id"), ["team1_id"], sums={"__w1": "won", "__g1": F.lit(1)}, hot=named[1])
    two = prior_state(one, ledger.withColumnRenamed("team_id", "team2_id"), ["team2_id"], sums={"__w2": "won", "__g2": F.lit(1)}, base=rows, hot=named[2])
    a, b = shrink.rate(F.col("__w1"), F.col("__g1"), 0.5), shrink.rate(F.col("__w2"), F.col("__g2"), 0.5)
    out = two.withColumn("p_map", F.coalesce(F.try_divide(a, a + b), F.lit(0.5)))
    return out.select(*rows.columns, "p_map", flat_vector(F.col("p_map"), F.col("best_of")).alias("probabilities"))


def outcome_index(wins1: Column, wins2: Column, best_of: Column) -> Column:
    """The place, from 0, of a final scoreline among those of its length; null if it is none of them."""
    found = by_length(best_of, lambda n: F.array_position(F.array(*[F.lit(f"{a}-{b}") for a, b in series.outcome_order(n)]), F.concat(wins1.cast("string"), F.lit("-"), wins2.cast("string"))), F.lit(0))
    return F.when(found > 0, (found - 1).cast("int"))


def series_outcomes(matches: DataFrame, maps: DataFrame) -> DataFrame:
    """(match_id, best_of, wins1, wins2, outcome_index) of completed matches whose finished maps decide them.

    Maps count in order until one side has enough; later ones are not looked at.
    A match that no side has won, or of a length that is not played, is left
    out. ``matches`` has best_of as a number.
    """
    own = matches.where("status = 'completed'").select("match_id", "best_of")
    won = F.col("team1_score") > F.col("team2_score")
    rows = maps.where("winner is not null").select("match_id", "map_index", won.cast("int").alias("one"), (~won).cast("int").alias("two")).join(own, "match_id")
    upto = W.partitionBy("match_id").orderBy("map_index").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("match_id", "best_of", "map_index", F.sum("one").over(upto).alias("wins1"), F.sum("two").over(upto).alias("wins2"))
    decided = rows.where(F.greatest("wins1", "wins2") == F.floor((F.col("best_of") + 1) / 2))
    first = decided.groupBy("match_id", "best_of").agg(F.min_by(F.struct("wins1", "wins2"), "map_index").alias("w")).select("match_id", "best_of", "w.*")
    return first.withColumn("outcome_index", outcome_index(F.col("wins1"), F.col("wins2"), F.col("best_of"))).where("outcome_index is not null")


def sweep_report(scored: DataFrame) -> DataFrame:
    """By best_of: count, and predicted and observed shares of sweeps by side A, by side B and by either, with their gaps.

    ``scored`` has best_of, probabilities and outcome_index; a vector of another
    length than its series fails the job.
    """
    v, k = F.col("probabilities"), F.col("best_of") + 1
    checked = F.when(F.size(v) == k, v).otherwise(F.raise_error(F.lit("a scoreline vector of another length than its series")).cast("array<double>"))
    rows = scored.select("best_of", F.col("outcome_index").alias("y"), checked.alias("v"))
    first, last = F.element_at("v", 1), F.element_at("v", -1)
    hit_a, hit_b = (F.col("y") == 0).cast("double"), (F.col("y") == F.size("v") - 1).cast("double")
    out = rows.groupBy("best_of").agg(
        F.count(F.lit(1)).alias("n_eval"), F.avg(first + last).alias("predicted_sweep"), F.avg(hit_a + hit_b).alias("observed_sweep"),
        F.avg(first).alias("predicted_a"), F.avg(hit_a).alias("observed_a"), F.avg(last).alias("predicted_b"), F.avg(hit_b).alias("observed_b"),
    )
    for x in ("sweep", "a", "b"):
        out = out.withColumn(f"gap_{x}", F.col(f"predicted_{x}") - F.col(f"observed_{x}"))
    return out


def series_scores(scored: DataFrame) -> DataFrame:
    """``scored`` with ranked probability score, log loss and whether the likelier winner won; rows without an outcome are left out."""
    v, y = F.col("probabilities"), F.col("outcome_index")
    n = F.size(v)
    steps = F.sequence(F.lit(1), n - 1)
    rps = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.pow(F.aggregate(F.slice(v, F.lit(1), i), F.lit(0.0), lambda a, x: a + x) - (y < i).cast("double"), F.lit(2.0)))
    log_loss = -F.log(F.greatest(F.element_at(v, y + 1), F.lit(1e-12)))
    half = (n / 2).cast("int")
    correct = (series.series_win(v) >= 0.5) == (y < half)
    return scored.where("outcome_index is not null").select("*", rps.alias("rps"), log_loss.alias("log_loss"), correct.alias("correct"))


def sensitivity(samples: DataFrame, key: str = "match_id", p: str = "p_series", weight: str = "p", level: float = 0.9) -> DataFrame:
    """(key, n, mean, variance, low, high): how the series chance varies over a match's sampled vetoes.

    Mean and variance are weighted by the sequences' chances; the band is that
    of the plain samples.
    """
    w, x = F.col(weight), F.col(p)
    mean = F.sum(w * x) / F.sum(w)
    moments = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), F.greatest(F.lit(0.0), F.sum(w * x * x) / F.sum(w) - mean * mean).alias("variance"))
    return moments.join(percentile_band(samples, [key], p, (1 - level) / 2, (1 + level) / 2), key)
