"""Series of maps: scoreline distributions from win probabilities of single maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def win_threshold(best_of: int) -> int:
    """Maps needed to win; the length is an odd positive number."""
    if isinstance(best_of, bool) or not isinstance(best_of, int) or best_of < 1 or best_of % 2 == 0:
        raise ValueError(f"best_of must be odd and positive, not {best_of!r}")
    return (best_of + 1) // 2


def outcome_order(best_of: int) -> list[tuple[int, int]]:
    """Scorelines: A's wins from a sweep down, then B's from the closest to a sweep."""
    w = win_threshold(best_of)
    return [(w, b) for b in range(w)] + [(a, w) for a in range(w - 1, -1, -1)]


def scorelines(p: Column, best_of: int) -> Column:
    """ARRAY<DOUBLE> over :func:`outcome_order` from ``best_of`` map probabilities of side A.

    The states are unrolled into one expression for each scoreline: a state's
    chance is the chance of the two states that it is reached from.
    """
    w = win_threshold(best_of)

    def at(i: int) -> Column:
        return F.element_at(p, i + 1)

    chance: dict[tuple[int, int], Column] = {(0, 0): F.lit(1.0)}
    for played in range(best_of):
        for a in range(played + 1):
            b = played - a
            if (a, b) not in chance or a == w or b == w:
                continue
            for key, step in (((a + 1, b), at(played)), ((a, b + 1), 1.0 - at(played))):
                term = chance[(a, b)] * step
                chance[key] = chance[key] + term if key in chance else term
    ok = (F.size(p) == best_of) & F.forall(p, lambda x: (x >= 0) & (x <= 1))
    return F.when(ok, F.array(*[chance[s] for s in outcome_order(best_of)])).otherwise(
        F.raise_error(F.lit("map probabilities must be as many as the series is long, in [0, 1]")).cast("array<double>")
    )


def series_win(vector: Column) -> Column:
    """Side A's chance of the series: the first half of the scorelines."""
    return F.aggregate(F.slice(vector, F.lit(1), F.floor(F.size(vector) / 2).cast("int")), F.lit(0.0), lambda a, x: a + x)
