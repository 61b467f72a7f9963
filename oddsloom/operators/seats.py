"""From matches and maps to one row for each team and map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OT_SCORE, REGULATION = 12, 13
CLOSE_MARGIN = 2
DETAIL = [f"team{s}_{x}_rounds" for s in (1, 2) for x in ("atk", "def")]


def is_overtime(a: Column, b: Column) -> Column:
    """Both sides reached twelve rounds."""
    return F.least(a, b) >= OT_SCORE


def above_regulation(a: Column, b: Column) -> Column:
    """A side won more rounds than regulation needs."""
    return F.greatest(a, b) > REGULATION


def is_close(a: Column, b: Column) -> Column:
    """A margin of two rounds or less."""
    return F.abs(a - b) <= CLOSE_MARGIN


def finished_maps(matches: DataFrame, maps: DataFrame) -> DataFrame:
    """Finished maps of completed matches with the match's time, teams, names and, if it has one, league."""
    league = [c for c in ("league",) if c in matches.columns]
    done = matches.where("status = 'completed'").select("match_id", "ts", "team1_id", "team2_id", "team1_name", "team2_name", *league)
    return maps.where("winner is not null").join(done, "match_id")


def seat_columns(own: int, of_map: Callable[[str], Column] = F.col, of_match: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What a seat's row says of a map, from the columns of the map and of its match."""
    c, o = (
        {k: of_match(f"team{s}_{k}") for k in ("id", "name")} | {k: of_map(f"team{s}_{k}") for k in ("score", "atk_rounds", "def_rounds")} for s in (own, 3 - own)
    )
    known = F.lit(True)
    for x in DETAIL:
        known = known & of_map(x).isNotNull()

    def detail(value: Column) -> Column:
        return F.when(known, value)

    ot = is_overtime(c["score"], o["score"])
    return {
        "seat": F.lit(own),
        "team_id": c["id"],
        "team_name": c["name"],
        "opponent_id": o["id"],
        "won": (c["score"] > o["score"]).cast("int"),
        "margin": c["score"] - o["score"],
        "ot": ot.cast("int"),
        "close": is_close(c["score"], o["score"]).cast("int"),
        "atk_won": detail(c["atk_rounds"]),
        "atk_played": detail(c["atk_rounds"] + o["def_rounds"]),
        "def_won": detail(c["def_rounds"]),
        "def_played": detail(c["def_rounds"] + o["atk_rounds"]),
        "ot_won": detail(F.when(ot, c["score"] - c["atk_rounds"] - c["def_rounds"]).otherwise(0)),
        "ot_played": detail(F.when(ot, c["score"] + o["score"] - 24).otherwise(0)),
        "signed_margin": detail(c["score"] - o["score"]),
    }


def seats(finished: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each map, one a team: won, margin, overtime, close, and the round detail (null where unknown).

    One scan: the two seats are made from the row, not by a union. Rounds are
    seen from the seat: attack rounds played are the own attack rounds won and
    the defence rounds won by the other side. Columns to ``keep`` are on both.
    """
    both = F.array(*[F.struct(*[c.alias(n) for n, c in seat_columns(s).items()]) for s in (1, 2)])
    return finished.select("match_id", "map_index", "map_name", "ts", *keep, F.inline(both))


def round_detail_breaches(maps: DataFrame) -> DataFrame:
    """Maps whose round detail contradicts the score, with a reason.

    Without overtime, attack and defence rounds add up to the score; with it, to
    twelve. Maps with all detail null are left out, some of it null is a breach.
    """
    known = [F.col(c).isNotNull().cast("int") for c in DETAIL]
    n = sum(known[1:], known[0])
    ot = is_overtime(F.col("team1_score"), F.col("team2_score"))

    def wrong(s: int) -> Column:
        return (F.col(f"team{s}_atk_rounds") + F.col(f"team{s}_def_rounds")) != F.when(ot, OT_SCORE).otherwise(F.col(f"team{s}_score"))

    reason = F.when((n > 0) & (n < 4), "partly null").when(wrong(1), "first seat's rounds").when(wrong(2), "second seat's rounds")
    return maps.withColumn("reason", reason).where("reason is not null").select("match_id", "map_index", "reason")


def legality(maps: DataFrame) -> DataFrame:
    """``maps`` with ``illegal``: why the scoreline cannot be one, or null."""
    hi, lo = F.greatest("team1_score", "team2_score"), F.least("team1_score", "team2_score")
    reason = (
        F.when(hi.isNull() | lo.isNull(), "null score")
        .when(F.col("team1_score") == F.col("team2_score"), "tie")
        .when(lo < 0, "negative")
        .when(hi < 13, "winner below 13")
        .when((lo >= OT_SCORE) & (hi - lo != 2), "overtime margin")
        .when((lo < OT_SCORE) & (hi != 13), "winner above 13 without overtime")
    )
    return maps.withColumn("illegal", reason)


def outcome_labels(maps: DataFrame, *keep: str) -> DataFrame:
    """(match_id, map_index, outcome_label, outcome_ordinal, round_margin) and columns to ``keep``; a tie or a null score fails the job."""
    a, b = F.col("team1_score"), F.col("team2_score")
    ot = is_overtime(a, b)
    bad = F.raise_error(F.lit("a map without a winner by score")).cast("int")
    ordinal = F.when((a > b) & ~ot, 0).when((a > b) & ot, 1).when((a < b) & ot, 2).when((a < b) & ~ot, 3).otherwise(bad)
    names = F.array(*[F.lit(x) for x in ("A_regulation", "A_OT", "B_OT", "B_regulation")])
    out = maps.select("match_id", "map_index", *keep, ordinal.cast("bigint").alias("outcome_ordinal"), F.abs(a - b).cast("bigint").alias("round_margin"))
    return out.select("match_id", "map_index", F.element_at(names, F.col("outcome_ordinal").cast("int") + 1).alias("outcome_label"), "outcome_ordinal", "round_margin", *keep)
