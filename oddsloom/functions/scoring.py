"""Proper scoring rules over probability vectors (ARRAY<DOUBLE>) and a true index from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def valid_vector(p: Column) -> Column:
    """Two entries or more, all finite and not negative, with sum 1 within the tolerance."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (F.size(p) >= 2) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0)) & (F.abs(total - 1.0) <= TOLERANCE)


def _checked(p: Column, truth: Column, score: Column) -> Column:
    ok = valid_vector(p) & (truth >= 0) & (truth < F.size(p))
    return F.when(F.coalesce(ok, F.lit(False)), score).otherwise(F.raise_error(F.lit("not a probability vector with a true index")).cast("double"))


def rps(p: Column, truth: Column) -> Column:
    """Sum over cuts of the squared gap between the cumulative vectors; not divided by their number."""
    cuts = F.sequence(F.lit(1), F.size(p) - 1)

    def gap(k: Column) -> Column:
        below = F.aggregate(F.slice(p, F.lit(1), k), F.lit(0.0), lambda a, x: a + x)
        return F.pow(below - F.when(truth < k, 1.0).otherwise(0.0), F.lit(2.0))

    return _checked(p, truth, F.aggregate(cuts, F.lit(0.0), lambda a, k: a + gap(k)))


def log_loss(p: Column, truth: Column) -> Column:
    """-ln of the true entry; a true entry of 0 fails the job."""
    chance = F.element_at(p, (truth + 1).cast("int"))
    loss = F.when(chance > 0, -F.log(chance)).otherwise(F.raise_error(F.lit("the true outcome has probability 0")).cast("double"))
    return _checked(p, truth, loss)


def brier(p: Column, truth: Column) -> Column:
    """Sum of squared differences over all categories."""
    terms = F.transform(p, lambda x, i: F.pow(x - F.when(i == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    return _checked(p, truth, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def side_a(p: Column, group: list[int] | None = None) -> Column:
    """Probability of side A: of the first half of the categories, or of ``group``."""
    if group is None:
        return F.aggregate(F.slice(p, F.lit(1), F.floor(F.size(p) / 2).cast("int")), F.lit(0.0), lambda a, x: a + x)
    return sum((F.element_at(p, i + 1) for i in group[1:]), F.element_at(p, group[0] + 1))


def side_correct(p: Column, truth: Column, group: list[int] | None = None) -> Column:
    """Whether the likelier side holds the truth; a tie goes to side A."""
    is_a = truth < F.floor(F.size(p) / 2) if group is None else truth.isin(group)
    return (side_a(p, group) >= 0.5) == is_a
