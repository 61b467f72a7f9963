"""Vetoes by match without sampling: chances of every set of maps that may be left, likeliest orders, exact series and leverage.

What a step chooses depends on the maps that are left, not on the order in which
the others went. So a veto is walked over sets of maps: 127 of them for a pool
of seven, in place of 5,040 orders, and orders that leave the same maps are
merged at every step. A match's scores are one row; nothing is shuffled but to
gather it. Series are carried along as a second part of the state (wins of both
sides), so that scorelines are exact as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import series
from oddsloom.functions.guards import positive_int, within
from oddsloom.operators.veto import SCRIPTS

#: Rows of a task's batch that are worked on together: a row holds a few kilobytes for each set of maps.
SLICE = 512
#: Orders that are written out together, about: an order is a list of names, so they are few for a batch of a few megabytes.
ORDERS_A_BATCH = 40_320
#: Sequences whose chances differ by less than this part are ordered by name.
SAME = 1e-9


@cache
def subsets(m: int) -> list[list[int]]:
    """By step, the sets of maps (as bits) that may be left before it; the last has one map each."""
    return [[s for s in range(1, 1 << m) if s.bit_count() == m - step] for step in range(m)]


def members(mask: int, m: int) -> list[int]:
    return [i for i in range(m) if mask >> i & 1]


@cache
def all_orders(m: int) -> np.ndarray:
    """(orders, m): every order of the maps."""
    return np.array(list(permutations(range(m))))


def step_chances(scores: np.ndarray) -> dict[int, np.ndarray]:
    """By set of maps, (rows, maps of the set): the softmax of the scores (rows, steps, maps) of the step at which so many are left."""
    m = scores.shape[2]
    out = {}
    for step, masks in enumerate(subsets(m)[:-1]):
        for mask in masks:
            x = scores[:, step, members(mask, m)]
            power = np.exp(x - x.max(axis=1, keepdims=True))
            out[mask] = power / power.sum(axis=1, keepdims=True)
    return out


def reach(chances: dict[int, np.ndarray], m: int) -> dict[int, np.ndarray]:
    """By set of maps, the chance that these are the ones left at their step; those of a step add up to 1."""
    n = len(chances[(1 << m) - 1])
    out = {mask: np.zeros(n) for masks in subsets(m) for mask in masks}
    out[(1 << m) - 1] += 1.0
    for masks in subsets(m)[:-1]:
        for mask in masks:
            for j, i in enumerate(members(mask, m)):
                out[mask & ~(1 << i)] += out[mask] * chances[mask][:, j]
    return out


def series_cells(chances: dict[int, np.ndarray], wins: np.ndarray, best_of: int, without: int | None = None) -> np.ndarray:
    """(rows, scorelines): the series' distribution over all vetoes, ``wins`` (rows, maps) being side A's chances.

    With ``without``, only of vetoes in which that map is not played, so the
    rows add up to the chance of those.
    """
    m, script = wins.shape[1], SCRIPTS[best_of]
    order = {s: i for i, s in enumerate(series.outcome_order(best_of))}
    need = series.win_threshold(best_of)
    out = np.zeros((len(wins), len(order)))
    state: dict[tuple[int, int, int], np.ndarray] = {((1 << m) - 1, 0, 0): np.ones(len(wins))}
    for step in range(m):
        after: dict[tuple[int, int, int], np.ndarray] = {}

        def add(key: tuple[int, int, int], p: np.ndarray, to: dict = after) -> None:
            to[key] = to[key] + p if key in to else p

        for (mask, a, b), p in state.items():
            for j, i in enumerate(members(mask, m)):
                here = p if step == m - 1 else p * chances[mask][:, j]
                left = mask & ~(1 << i)
                if script[step] == "ban":
                    add((left, a, b), here)
                elif i == without:
                    continue
                elif need in (a, b):
                    # The series is over; what is played no more only tells which veto it was.
                    add((left, a, b), here)
                else:
                    add((left, a + 1, b), here * wins[:, i])
                    add((left, a, b + 1), here * (1 - wins[:, i]))
        state = after
    for (_, a, b), p in state.items():
        out[:, order[a, b]] += p
    return out


def likeliest(chances: dict[int, np.ndarray], row: int, m: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` likeliest orders of a row, best first; chances that are the same but for rounding are ordered by map.

    A best-first search: what an unfinished order can still reach is the
    product of its chance and the best completion of the maps that are left,
    which is known for every set beforehand, so only parts of the found orders
    are opened.
    """
    best = {1 << i: 1.0 for i in range(m)}
    for masks in reversed(subsets(m)[:-1]):
        for mask in masks:
            best[mask] = max(float(chances[mask][row, j]) * best[mask & ~(1 << i)] for j, i in enumerate(members(mask, m)))
    full = (1 << m) - 1
    heap: list[tuple[float, tuple[int, ...], float, int]] = [(-best[full], (), 1.0, full)]
    found: list[tuple[float, tuple[int, ...]]] = []
    while heap:
        bound, order, p, mask = heapq.heappop(heap)
        if len(found) >= n and -bound < found[n - 1][0] * (1 - SAME):
            break
        if mask & (mask - 1) == 0:
            found.append((p, (*order, mask.bit_length() - 1)))
            continue
        for j, i in enumerate(members(mask, m)):
            q = p * float(chances[mask][row, j])
            heapq.heappush(heap, (-q * best[mask & ~(1 << i)], (*order, i), q, mask & ~(1 << i)))
    # Runs of the same chance, by map.
    found.sort(key=lambda x: -x[0])
    out: list[tuple[float, tuple[int, ...]]] = []
    run: list[tuple[float, tuple[int, ...]]] = []
    for x in found:
        if run and x[0] < run[0][0] * (1 - SAME):
            out += sorted(run, key=lambda y: y[1])
            run = []
        run.append(x)
    return (out + sorted(run, key=lambda y: y[1]))[:n]


def gathered(utilities: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, maps, scores): a match's maps in order of name, and its scores step by step over these maps.

    ``utilities`` has (key, step, map_name, score) for each map at each step but
    the last, once. Anything else fails the job, as do null scores. Rows that
    are gathered already (key, maps, scores), one for each key, are not shuffled.
    """
    if "scores" in utilities.columns:
        in_order = F.coalesce((F.size("maps") > 1) & (F.array_distinct(F.array_sort("maps")) == F.col("maps")) & (F.size("scores") == F.size("maps") * (F.size("maps") - 1)), F.lit(False))
        known = in_order & F.forall("scores", lambda x: x.isNotNull() & ~F.isnan(x))
        return utilities.select(key, "maps", F.when(known, F.col("scores").cast("array<double>")).otherwise(_unscored(key)).alias("scores"))
    cells = F.array_sort(F.collect_list(F.struct("step", "map_name", F.col("score").cast("double").alias("score"))))
    rows = utilities.groupBy(key).agg(cells.alias("cells"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("map_name")).alias("maps"))
    steps = F.size("maps") - 1
    want = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda s: F.transform("maps", lambda m: F.struct(s.cast("int").alias("step"), m.alias("map_name")))))
    have = F.transform("cells", lambda c: F.struct(c["step"].cast("int").alias("step"), c["map_name"].alias("map_name")))
    whole = (steps >= 1) & (F.col("n") == steps * F.size("maps")) & (have == want) & F.forall("cells", lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]))
    scores = F.when(F.coalesce(whole, F.lit(False)), F.transform("cells", lambda c: c["score"]))
    return rows.select(key, "maps", F.coalesce(scores, _unscored(key)).alias("scores"))


def _unscored(key: str) -> Column:
    return F.raise_error(F.concat(F.lit("a veto needs one score of each map at each step: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("array<double>")


def _by_match(rows: DataFrame, schema: str, work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], most: Callable[[int], int] = lambda m: SLICE) -> DataFrame:
    """``work(batch, scores)`` over slices of gathered rows whose pools are of one size, ``most(size)`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("maps").value_lengths().to_numpy()
            for m in np.unique(size).tolist():
                same = batch.take(pa.array(np.flatnonzero(size == m)))
                for at in range(0, same.num_rows, most(m)):
                    piece = same.slice(at, most(m))
                    yield work(piece, piece.column("scores").flatten().to_numpy().reshape(piece.num_rows, m - 1, m))

    return rows.mapInArrow(run, schema)


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def state_chances(utilities: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, step, remaining, p): the chance of every set of maps that may be left before a step; by step they add up to 1."""

    def work(piece: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        m, names = scores.shape[2], piece.column("maps").to_pylist()
        p = reach(step_chances(scores), m)
        masks = [mask for masks in subsets(m) for mask in masks]
        steps = np.array([m - mask.bit_count() for mask in masks], np.int32)
        remaining = [[row[i] for i in members(mask, m)] for row in names for mask in masks]
        return pa.RecordBatch.from_arrays(
            [piece.column(key).take(pa.array(np.repeat(np.arange(len(names)), len(masks)))), pa.array(np.tile(steps, len(names))), pa.array(remaining, pa.list_(pa.string())), pa.array(np.stack([p[mask] for mask in masks], axis=1).reshape(-1))],
            [key, "step", "remaining", "p"],
        )

    return _by_match(gathered(utilities, key), f"{key} {_kind(utilities, key)}, step int, remaining array<string>, p double", work)


def step_marginals(utilities: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, step, map_name, p): the chance of each map to go at each step, the last one the decider's."""

    def work(piece: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        n, m = len(scores), scores.shape[2]
        chances = step_chances(scores)
        left = reach(chances, m)
        p = np.zeros((n, m, m))
        for step, masks in enumerate(subsets(m)):
            for mask in masks:
                p[:, step, members(mask, m)] += left[mask][:, None] * (chances[mask] if step < m - 1 else 1.0)
        # Names are taken by place, as in all orders.
        maps = piece.column("maps").flatten().take(pa.array(np.repeat(np.arange(n * m).reshape(n, m), m, axis=0).reshape(-1)))
        return pa.RecordBatch.from_arrays(
            [piece.column(key).take(pa.array(np.repeat(np.arange(n), m * m))), pa.array(np.tile(np.repeat(np.arange(m, dtype=np.int32), m), n)), maps, pa.array(p.reshape(-1))],
            [key, "step", "map_name", "p"],
        )

    return _by_match(gathered(utilities, key), f"{key} {_kind(utilities, key)}, step int, map_name string, p double", work)


def enumerate_sequences(utilities: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, sequence, p): every order of a match's pool with its chance; 5,040 rows a match for seven maps."""

    def work(piece: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        n, m = len(scores), scores.shape[2]
        orders = all_orders(m)
        chances = np.zeros((n, 1 << m, m))
        for mask, p in step_chances(scores).items():
            chances[:, mask, members(mask, m)] = p
        p, left = np.ones((n, len(orders))), np.full(len(orders), (1 << m) - 1)
        for i in orders.T[:-1]:
            p *= chances[:, left, i]
            left = left & ~(1 << i)
        # Names are taken by place, so no order is a list of Python's.
        names = piece.column("maps").flatten().take(pa.array((np.arange(n)[:, None] * m + orders.reshape(-1)).reshape(-1)))
        sequences = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(orders) * m + 1, m, dtype=np.int32)), names)
        return pa.RecordBatch.from_arrays([piece.column(key).take(pa.array(np.repeat(np.arange(n), len(orders)))), sequences, pa.array(p.reshape(-1))], [key, "sequence", "p"])

    schema = f"{key} {_kind(utilities, key)}, sequence array<string>, p double"
    return _by_match(gathered(utilities, key), schema, work, lambda m: max(1, ORDERS_A_BATCH // len(all_orders(m))))


def top_sequences(utilities: DataFrame, n: int, key: str = "match_id") -> DataFrame:
    """(key, rank, sequence, p): the ``n`` likeliest vetoes of each match, ties by the sequence; fewer if a pool has fewer orders."""
    positive_int(n, "n")

    def work(piece: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        m, names = scores.shape[2], piece.column("maps").to_pylist()
        chances = step_chances(scores)
        found = [likeliest(chances, row, m, n) for row in range(len(scores))]
        return pa.RecordBatch.from_arrays(
            [
                piece.column(key).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))),
                pa.array([r + 1 for f in found for r in range(len(f))], pa.int32()),
                pa.array([[row[i] for i in order] for row, f in zip(names, found, strict=True) for _, order in f], pa.list_(pa.string())),
                pa.array([p for f in found for p, _ in f], pa.float64()),
            ],
            [key, "rank", "sequence", "p"],
        )

    return _by_match(gathered(utilities, key), f"{key} {_kind(utilities, key)}, rank int, sequence array<string>, p double", work)


def _with_wins(utilities: DataFrame, wins: DataFrame, lengths: DataFrame, key: str, kind: str) -> DataFrame:
    """Gathered rows with best_of and, map by map in order of name, the column ``a`` of ``wins``."""
    side = F.map_from_entries(F.collect_list(F.struct("map_name", F.col("a").cast(kind).alias("a"))))
    rows = gathered(utilities, key).join(wins.groupBy(key).agg(side.alias("side")), key, "left").join(lengths.select(key, "best_of"), key)
    a = F.transform("maps", lambda m: F.try_element_at("side", m))
    chance = lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False))
    inside = F.forall(a, chance) if kind == "double" else F.forall(a, lambda x: F.coalesce((F.size(x) > 0) & (F.size(x) == F.size(a[0])) & F.forall(x, chance), F.lit(False)))
    inside = inside & F.col("best_of").isin(list(SCRIPTS)) & (F.size("maps") == len(SCRIPTS[1]))
    return rows.select(key, "maps", "scores", F.col("best_of").cast("int").alias("best_of"), F.when(F.coalesce(inside, F.lit(False)), a).otherwise(F.raise_error(F.lit("a veto without a script for its length and pool, or a map without a chance")).cast(f"array<{kind}>")).alias("wins"))


def series_bands(utilities: DataFrame, wins: DataFrame, lengths: DataFrame, level: float = 0.9, key: str = "match_id") -> DataFrame:
    """(key, n, mean, low, high): side A's exact chance of the series by every replicate, as a mean and a band.

    ``wins`` has (key, map_name, a) with an array: side A's chance on the map by
    every replicate, as many for all maps of a match. All replicates of a match
    are walked in one pass over its sets of maps. Otherwise as :func:`exact_series`.
    """
    within(level, 0, 1, "level")
    edges = [50 * (1 - level), 50 * (1 + level)]

    def work(piece: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        n, m = len(scores), scores.shape[2]
        chances, length = step_chances(scores), piece.column("best_of").to_numpy()
        by_map = piece.column("wins").to_pylist()
        found = np.zeros((n, 4))
        for best_of in np.unique(length).tolist():
            for size in {len(row[0]) for row, b in zip(by_map, length.tolist(), strict=True) if b == best_of}:
                own = np.array([i for i, row in enumerate(by_map) if length[i] == best_of and len(row[0]) == size])
                # (rows x replicates, maps): a replicate is a row with the same veto.
                a = np.array([by_map[i] for i in own]).transpose(0, 2, 1).reshape(-1, m)
                cells = series_cells({mask: np.repeat(p[own], size, axis=0) for mask, p in chances.items()}, a, best_of)
                won = cells[:, : cells.shape[1] // 2].sum(axis=1).reshape(len(own), size)
                low, high = np.percentile(won, edges, axis=1)
                found[own] = np.stack([np.full(len(own), size), won.mean(axis=1), low, high], axis=1)
        return pa.RecordBatch.from_arrays([piece.column(key), pa.array(found[:, 0].astype(np.int32)), *[pa.array(found[:, i]) for i in (1, 2, 3)]], [key, "n", "mean", "low", "high"])

    return _by_match(_with_wins(utilities, wins, lengths, key, "array<double>"), f"{key} {_kind(utilities, key)}, n int, mean double, low double, high double", work)


def exact_series(utilities: DataFrame, wins: DataFrame, lengths: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, best_of, probabilities, leverage) over all vetoes: scorelines in the order of the series, and what each map moves.

    ``wins`` has (key, map_name, a): side A's chance on the map; ``lengths`` has
    (key, best_of). ``leverage`` has a struct (map_name, p_played, swing) for
    each map that some vetoes play and others do not: side A's chance of the
    series if it is played less that if it is not. A length without a script, a
    pool of another size or a map without a chance fails the job.
    """
    rows = _with_wins(utilities, wins, lengths, key, "double")

    def work(piece: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        n, m = len(scores), scores.shape[2]
        chances, a = step_chances(scores), piece.column("wins").flatten().to_numpy().reshape(n, m)
        names, length = piece.column("maps").to_pylist(), piece.column("best_of").to_numpy()
        cells: list[list[float]] = [[]] * n
        swings: list[list[dict]] = [[] for _ in range(n)]
        for best_of in np.unique(length).tolist():
            own = np.flatnonzero(length == best_of)
            part = {mask: p[own] for mask, p in chances.items()}
            whole = series_cells(part, a[own], best_of)
            half = whole.shape[1] // 2
            for row, p in zip(own.tolist(), whole.tolist(), strict=True):
                cells[row] = p
            won = whole[:, :half].sum(axis=1)
            for i in range(m):
                rest = series_cells(part, a[own], best_of, i)
                out, lost = rest.sum(axis=1), rest[:, :half].sum(axis=1)
                for k, row in enumerate(own.tolist()):
                    if SAME < out[k] < 1 - SAME:
                        swings[row].append({"map_name": names[row][i], "p_played": 1 - out[k], "swing": (won[k] - lost[k]) / (1 - out[k]) - lost[k] / out[k]})
        kind = pa.list_(pa.struct([("map_name", pa.string()), ("p_played", pa.float64()), ("swing", pa.float64())]))
        return pa.RecordBatch.from_arrays([piece.column(key), piece.column("best_of"), pa.array(cells, pa.list_(pa.float64())), pa.array(swings, kind)], [key, "best_of", "probabilities", "leverage"])

    return _by_match(rows, f"{key} {_kind(utilities, key)}, best_of int, probabilities array<double>, leverage array<struct<map_name:string,p_played:double,swing:double>>", work)
