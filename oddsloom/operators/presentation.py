"""What a reader of predictions sees: fixtures with maps, bands, scorelines and the maps that matter."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import series
from oddsloom.operators.reports import latest_name


def display_names(matches: DataFrame) -> DataFrame:
    """(team_id, team_name): the latest name of each team, ties by match."""
    seats = F.array(F.struct(F.col("team1_id").alias("team_id"), F.col("team1_name").alias("team_name")), F.struct(F.col("team2_id").alias("team_id"), F.col("team2_name").alias("team_name")))
    return latest_name(matches.select("ts", "match_id", F.inline(seats)), "team_id", "team_name", "ts", "match_id")


def scoreline_labels(best_of: int) -> list[str]:
    """Labels a-b in the order of the scorelines."""
    return [f"{a}-{b}" for a, b in series.outcome_order(best_of)]


def derived(vector: Column, best_of: int) -> Column:
    """Struct of the series chance, the likeliest scoreline, its chance, and whether the series goes the distance."""
    labels = F.array(*[F.lit(x) for x in scoreline_labels(best_of)])
    most = F.array_max(vector)
    full = [i for i, (a, b) in enumerate(series.outcome_order(best_of)) if a + b == best_of]
    distance = sum((F.element_at(vector, i + 1) for i in full[1:]), F.element_at(vector, full[0] + 1))
    return F.struct(
        series.series_win(vector).alias("p_series"), F.element_at(labels, F.array_position(vector, most).cast("int")).alias("likeliest"), most.alias("p_likeliest"), distance.alias("p_distance")
    )


def map_block(p: Column) -> Column:
    """Struct of a four-way map forecast: the side's chance and the chance of overtime."""
    return F.struct((p[0] + p[1]).alias("p_a"), (p[1] + p[2]).alias("p_overtime"), p.alias("cells"))


def flips(p: Column, low: Column, high: Column) -> Column:
    """Whether the band crosses one half, strictly."""
    return ((low < 0.5) & (high > 0.5)) & (p != 0.5)


def coverage_gap(listing: DataFrame, p: str, weight: str, overall: str) -> DataFrame:
    """(gap): the weighted mean over the listed sequences less the overall chance."""
    return listing.agg((F.sum(F.col(weight) * F.col(p)) / F.sum(weight) - F.max(overall)).alias("gap"))


def fixture_artifact(fixtures: DataFrame, vectors: DataFrame, maps: DataFrame, names: DataFrame, best_of: int) -> DataFrame:
    """(match_id, fixture) with a nested struct for each fixture: teams, maps, scorelines and derived values."""
    a = names.select(F.col("team_id").alias("team_a_id"), F.col("team_name").alias("a_name"))
    b = names.select(F.col("team_id").alias("team_b_id"), F.col("team_name").alias("b_name"))
    own = maps.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("map_index", "map_name", map_block(F.col("p")).alias("forecast")))).alias("maps"))
    rows = fixtures.join(a, "team_a_id", "left").join(b, "team_b_id", "left").join(own, "match_id", "left").join(vectors.select("match_id", "probabilities"), "match_id", "left")
    labels = F.array(*[F.lit(x) for x in scoreline_labels(best_of)])
    fixture = F.struct(
        "match_id", "scheduled_at",
        F.struct(F.col("team_a_id").alias("id"), F.col("a_name").alias("name")).alias("team_a"), F.struct(F.col("team_b_id").alias("id"), F.col("b_name").alias("name")).alias("team_b"),
        "maps", F.arrays_zip(labels.alias("scoreline"), F.col("probabilities").alias("p")).alias("scorelines"), derived(F.col("probabilities"), best_of).alias("derived"),
    )
    return rows.select("match_id", fixture.alias("fixture"))


def write_report(report: dict, path: str) -> None:
    """JSON with sorted keys, put in place in one step; for reports of a few rows."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".tmp", delete=False, encoding="utf-8") as f:
        json.dump(report, f, sort_keys=True, indent=2)
    os.replace(f.name, path)
