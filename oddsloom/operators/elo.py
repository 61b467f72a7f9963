"""Sequential ratings: one ordered fold over the maps of a league."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.guards import positive

SCALE = 400.0


def expected_score(own: float, other: float) -> float:
    """The chance of the first rating against the second."""
    return 1.0 / (1.0 + 10.0 ** ((other - own) / SCALE))


def fold_maps(
    leagues: Iterable[str | None], ones: Iterable[str | None], twos: Iterable[str | None], first_won: Iterable[bool | int], ratings: dict[tuple, float], k: float, start: float
) -> tuple[list[float], list[float]]:
    """Both teams' ratings after each map, in order; ``ratings`` by league and team are read and changed."""
    out1, out2 = [], []
    for lg, a, b, won in zip(leagues, ones, twos, first_won, strict=True):
        ra, rb = ratings.get((lg, a), start), ratings.get((lg, b), start)
        gain = k * ((1.0 if won else 0.0) - expected_score(ra, rb))
        ratings[lg, a], ratings[lg, b] = ra + gain, rb - gain
        out1.append(ra + gain), out2.append(rb - gain)
    return out1, out2


def elo_ledger(finished: DataFrame, k: float = 32.0, start: float = 1500.0, league: str | None = None) -> DataFrame:
    """(team_id, ts, match_id, map_index, rating) after every map, two rows a map.

    A rating depends on all maps before it through both teams, so a league is
    one ordered stream: its rows are sorted by Spark and folded in batches by
    one task, which holds the ratings and nothing else. Leagues run in parallel.
    """
    k = positive(k, "k")
    if not math.isfinite(start):
        raise ValueError("the start rating must be finite")
    name = F.col(league).cast("string") if league else F.lit("all")
    rows = finished.select(name.alias("league"), "ts", "match_id", "map_index", "team1_id", "team2_id", (F.col("team1_score") > F.col("team2_score")).alias("first_won"))
    order = ["league", "ts", "match_id", "map_index"]
    dealt = rows.repartition("league").sortWithinPartitions(*order) if league else rows.repartition(1).sortWithinPartitions(*order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[tuple, float] = {}
        for batch in batches:
            out1, out2 = fold_maps(batch.league, batch.team1_id, batch.team2_id, batch.first_won, ratings, k, start)
            for team, rating in (("team1_id", out1), ("team2_id", out2)):
                yield pd.DataFrame({"team_id": batch[team], "ts": batch.ts, "match_id": batch.match_id, "map_index": batch.map_index, "rating": rating})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return dealt.mapInPandas(fold, f"team_id {kinds['team1_id']}, ts {kinds['ts']}, match_id {kinds['match_id']}, map_index {kinds['map_index']}, rating double")
