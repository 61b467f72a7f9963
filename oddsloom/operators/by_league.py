"""Everything that is known of both sides of a map before its time, league by league.

Where no team plays in two leagues, a league's matches are all that its teams
have played, and both sides of a match lie in it: rows of matches are dealt once,
by league, and what the features need is found on Arrow batches of whole
leagues. Nothing is dealt by team, and sides need not meet again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from oddsloom.functions import asof, names
from oddsloom.operators.elo import fold_maps
from oddsloom.operators.seats import seat_columns

if TYPE_CHECKING:
    from oddsloom.operators.features import FeatureConfig, Tables

MATCH = ["match_id", "ts", "event_name", "team1_id", "team2_id", "team1_name", "team2_name"]
#: Sums by team, and by team and map; what is added up of a finished map of a side.
RATES = ("wins", "games", "a_won", "a_n", "m_s", "m_n", "b_won", "b_n")


def apart(t: Tables) -> bool:
    """Whether every known team is of one league alone, and no league has very many maps; found by two jobs over the stored matches."""
    m = t.every_match
    teams = m.select("league", F.explode(F.array("team1_id", "team2_id")).alias("team_id")).where("team_id is not null")
    found = teams.groupBy("team_id").agg(F.min("league").alias("a"), F.max("league").alias("z"), F.bool_or(F.col("league").isNull()).alias("without"))
    if not found.where("without or a <> z").isEmpty():
        return False
    return m.groupBy("league").agg(F.sum(F.greatest(F.coalesce(F.size("indexes"), F.lit(0)), F.lit(1))).alias("n")).where(F.col("n") > asof.HOT_ROWS).isEmpty()


class _Before:
    """Rows of groups in the order of ``at``, rows of one time as they came: what of a group is strictly before each row."""

    def __init__(self, group: np.ndarray, at: np.ndarray, known: np.ndarray):
        self.order, self.known = np.lexsort((at, group)), known
        g, a, place = group[self.order], at[self.order], np.arange(len(group))
        first = np.concatenate([[True], g[1:] != g[:-1]])
        self.start = np.maximum.accumulate(np.where(first, place, 0))
        self.same = np.maximum.accumulate(np.where(first | np.concatenate([[True], a[1:] != a[:-1]]), place, 0))

    def total(self, values: np.ndarray) -> np.ndarray:
        until = np.concatenate([[0], np.cumsum(np.where(self.known, values, 0)[self.order])])
        found = np.empty_like(until[1:])
        found[self.order] = until[self.same] - until[self.start]
        return np.where(self.known, found, 0)

    def last(self, counts: np.ndarray) -> np.ndarray:
        """The row that counts and is the last before, or -1."""
        place = np.arange(len(self.order))
        until = np.concatenate([[-1], np.maximum.accumulate(np.where((counts & self.known)[self.order], place, -1))])[self.same]
        found = np.empty_like(place)
        found[self.order] = np.where(until >= self.start, self.order[until], -1)
        return np.where(self.known, found, -1)


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """The columns' values as whole numbers that are equal where values are; -1 for null."""
    whole = pc.fill_null(pa.concat_arrays(columns).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(whole, np.cumsum([len(c) for c in columns])[:-1])


def _ints(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _sides(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Side 1 and side 2 of each row in turn."""
    return np.stack([one, two], axis=1).ravel()


def _jaccard(row: np.ndarray, name: np.ndarray, n: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's set of names and that of the row before (-1 for none) the part of the union that is shared, and where there is a union."""
    width = int(name.max(initial=0)) + 1
    cells = np.unique(row * width + name)
    of, what = cells // width, cells % width
    size = np.bincount(of, minlength=n)
    asked = before[of] * width + what
    at = np.minimum(np.searchsorted(cells, asked), max(len(cells) - 1, 0))
    shared = np.bincount(of[(before[of] >= 0) & (cells[at] == asked)], minlength=n) if len(cells) else np.zeros(n, np.int64)
    union = size + np.where(before >= 0, size[before], 0) - shared
    there = (before >= 0) & (union > 0)
    return np.where(there, shared / np.maximum(union, 1), 0.0), there


def known_before(t: Tables, c: FeatureConfig, n_maps: int, rating: bool = True) -> DataFrame:
    """(match_id, map_index, map_name, ts, event_stage) of every map, and for sides 1 and 2 what :func:`features.feature_matrix` reads by levels.

    Names end with the side. Form is a number, not the values; without
    ``rating`` no ratings are folded. :func:`apart` must hold: the rows of one
    league pass through a task's memory.
    """
    at = asof.order_number(F.col("ts"), t.every_match.schema["ts"].dataType)
    dealt = t.every_match.select("league", *MATCH, "status", "indexes", "items").repartition(asof.tasks_for(n_maps, t.every_match), "league")
    dealt = dealt.withColumn("__at", at).sortWithinPartitions("league", "__at", "match_id")
    # Days are told apart as floor_days does.
    dealt = dealt.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    maps = dealt.select("league", "__at", "__us", *MATCH, "status", "indexes", F.posexplode_outer("items").alias("__pos", "__x"))
    maps = maps.select("league", "__at", "__us", *MATCH, "status", "__pos", F.get("indexes", F.col("__pos")).alias("map_index"), *[x.alias(n) for n, x in t.map_columns(F.col("__x")).items()])
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    # A match without maps is a row of its own, which only says when its teams have played.
    finished = done & F.col("__pos").isNotNull() & F.col("winner").isNotNull()
    place = F.when(F.col("__pos").isNotNull() & F.col("map_name").isNotNull(), F.array_position(F.lit(t.pool), F.col("map_name"))).cast("int")

    # A player without a team is nobody's. The filter also keeps this projection out of the stage's one method, which would be too long for the JVM to compile.
    players = F.filter(t.player_cells(), lambda x: x["team_name"].isNotNull())

    def seat(s: int) -> list[Column]:
        own = seat_columns(s)
        return [F.when(finished, own[n]).cast("int").alias(f"{n}{s}") for n in ("won", "ot", "atk_won", "atk_played", "signed_margin")]

    rows = maps.select("league", "__at", "__us", "__pos", *MATCH, "map_index", "map_name", done.alias("__done"), finished.alias("__finished"), place.alias("__place"), *seat(1), *seat(2), F.when(finished, players).alias("__players"), F.when(F.col("__pos").isNotNull(), names.event_stage(F.col("event_name")).cast("double")).alias("event_stage"))
    rows = rows.drop("event_name")
    kinds = {f.name: f for f in rows.schema.fields}
    keep = ["match_id", "map_index", "map_name", "ts", "event_stage"]
    whole = [*[f"team_{n}" for n in RATES], "team_ots", *[f"map_{n}" for n in RATES], "pair_wins", "pair_games"]
    values = {**{n: Ty.LongType() for n in whole}, **{n: Ty.DoubleType() for n in ("rating", "acs_form", "rating_form", "same")}, **{n: Ty.LongType() for n in ("roster_days", "last_days")}}
    schema = Ty.StructType([*[kinds[n] for n in keep], *[Ty.StructField(f"{n}{s}", k) for s in (1, 2) for n, k in values.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in asof._whole_keys(batches, "league"):
            one = {n: table.column(n).combine_chunks() for n in table.column_names}
            n = table.num_rows
            time = _sides(*[_ints(pc.fill_null(one["__at"], np.iinfo(np.int64).min))] * 2)
            own1, own2 = _codes(one["team1_id"], one["team2_id"])
            team, other = _sides(own1, own2), _sides(own2, own1)
            known = np.repeat(_valid(one["__at"]), 2) & (team >= 0)
            finished, done = (np.repeat(one[x].to_numpy(zero_copy_only=False), 2) for x in ("__finished", "__done"))
            place = np.repeat(_ints(one["__place"]), 2)
            made: dict[str, np.ndarray | pa.Array] = {}

            # The players of a side are those of its name.
            cells = one["__players"].flatten()
            row = np.repeat(np.arange(n), _ints(pc.list_value_length(one["__players"])))
            of, name1, name2 = _codes(cells.field("team_name"), one["team1_name"], one["team2_name"])
            mine = [np.flatnonzero((of >= 0) & (of == x[row])) for x in (name1, name2)]
            side = np.concatenate([2 * row[mine[0]], 2 * row[mine[1]] + 1])
            mine = np.concatenate(mine)

            def added(field: str) -> tuple[np.ndarray, np.ndarray]:
                there = _valid(cells.field(field))[mine]
                x = pc.fill_null(cells.field(field), 0).to_numpy(zero_copy_only=False).astype(np.float64)[mine]
                return np.bincount(side[there], x[there], 2 * n), np.bincount(side[there], minlength=2 * n)

            roster = np.bincount(side, minlength=2 * n) > 0
            (fk, fk_n), (fd, fd_n) = added("first_kills"), added("first_deaths")
            blood = fk.astype(np.int64), np.where((fk_n > 0) & (fd_n > 0), fk + fd, 0).astype(np.int64)
            won, ot, a_won, a_n, margin = (_sides(*[_ints(one[f"{x}{s}"]) for s in (1, 2)]) for x in ("won", "ot", "atk_won", "atk_played", "signed_margin"))
            detail = _sides(*[_valid(one[f"signed_margin{s}"]) for s in (1, 2)]).astype(np.int64)
            rates = dict(zip(RATES, (won, finished.astype(np.int64), a_won, a_n, margin, detail, *blood), strict=True))

            by_team = _Before(team, time, known)
            made |= {f"team_{x}": by_team.total(v) for x, v in rates.items()} | {"team_ots": by_team.total(ot)}
            by_map = _Before(team * 256 + place, time, known & (place > 0))
            made |= {f"map_{x}": by_map.total(v) for x, v in rates.items()}
            by_pair = _Before(team * (int(team.max(initial=0)) + 2) + other, time, known & (other >= 0))
            made |= {"pair_wins": by_pair.total(won), "pair_games": by_pair.total(rates["games"])}

            # Rosters in a team's order: each against the one before, and the last ones' means.
            listed = by_team.order[roster[by_team.order]]
            number = np.zeros(2 * n, np.int64)
            number[listed] = np.arange(len(listed))
            begins = np.concatenate([[True], team[listed][1:] != team[listed][:-1]])[: len(listed)]
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(listed)), 0)) if len(listed) else np.zeros(0, np.int64)
            before = np.full(2 * n, -1)
            before[listed] = np.where(begins, -1, np.roll(listed, 1))
            (player,) = _codes(cells.field("player_name"))
            named = player[mine] >= 0
            same, there = _jaccard(side[named], player[mine][named], 2 * n, before)
            latest = by_team.last(roster)
            made["same"] = pa.array(same[latest], mask=(latest < 0) | ~there[latest])
            for out, field in (("acs_form", "acs"), ("rating_form", "rating")):
                total, count = added(field)
                mean = total / np.maximum(count, 1)
                at_row = by_team.last(roster & (count > 0))
                sums, weights, i = np.zeros(2 * n), np.zeros(2 * n), np.zeros(2 * n, np.int64)
                decays = np.array([c.form_decay**j for j in range(c.form_maps)])
                for j in range(c.form_maps if len(listed) else 0):
                    p = number[at_row] - j
                    inside = (at_row >= 0) & (p >= begin[number[at_row]])
                    here = listed[np.maximum(p, 0)]
                    inside &= count[here] > 0
                    w = np.where(inside, decays[i], 0.0)
                    sums, weights, i = sums + np.where(inside, mean[here], 0.0) * w, weights + w, i + inside
                made[out] = pa.array(np.divide(sums, weights, out=np.zeros(2 * n), where=weights > 0), mask=at_row < 0)
            us = np.repeat(_ints(one["__us"]), 2)
            for out, row_of in (("roster_days", latest), ("last_days", by_team.last(done))):
                made[out] = pa.array((us - us[row_of]) // 86_400_000_000, mask=row_of < 0)
            if rating:
                after = np.zeros(2 * n)
                at_maps = np.flatnonzero(finished[::2])
                asked = [pc.take(one[x], pa.array(at_maps)).to_pylist() for x in ("league", "team1_id", "team2_id")]
                after[2 * at_maps], after[2 * at_maps + 1] = fold_maps(*asked, won[2 * at_maps].tolist(), {}, c.elo_k, c.elo_start)
                rated = by_team.last(finished)
                made["rating"] = pa.array(after[rated], mask=rated < 0)
            else:
                made["rating"] = pa.nulls(2 * n, pa.float64())
            cut = {f"{x}{s}": pa.array(v[s - 1 :: 2]) if isinstance(v, np.ndarray) else v.take(pa.array(np.arange(s - 1, 2 * n, 2))) for x, v in made.items() for s in (1, 2)}
            batch = pa.RecordBatch.from_arrays([*[one[x] for x in keep], *[cut[x.name] for x in schema.fields[len(keep) :]]], names=schema.fieldNames())
            yield batch.filter(one["__pos"].is_valid())

    return rows.mapInArrow(run, schema)
