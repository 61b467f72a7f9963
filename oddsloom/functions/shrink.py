"""Shrinkage of rates and means towards a prior."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_mean(wins: Column, games: Column, prior: Column, k: float) -> Column:
    """Mean of Beta(wins + k prior, losses + k (1 - prior))."""
    return (wins + F.lit(float(k)) * prior) / (games + F.lit(float(k)))


def beta_posterior(wins: Column, games: Column, prior: Column, k: float) -> Column:
    """Struct of alpha, beta, mean and variance of the same distribution."""
    a = wins + F.lit(float(k)) * prior
    b = (games - wins) + F.lit(float(k)) * (F.lit(1.0) - prior)
    n = a + b
    return F.struct(a.alias("alpha"), b.alias("beta"), (a / n).alias("mean"), (a * b / (n * n * (n + 1.0))).alias("variance"))


def rate(wins: Column, games: Column, default: float) -> Column:
    """wins / games, or the default where there are none."""
    return F.coalesce(F.try_divide(wins.cast("double"), games.cast("double")), F.lit(float(default)))


def normal_mean(total: Column, n: Column, prior: Column, k: float) -> Column:
    """(total + k prior) / (n + k)."""
    return (total + F.lit(float(k)) * prior) / (n + F.lit(float(k)))


def sample_variance(n: Column, total: Column, squares: Column) -> Column:
    """Variance with n - 1 from a count, a sum and a sum of squares; null for one value or none."""
    n = n.cast("double")
    return F.when(n > 1, F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1.0)))
