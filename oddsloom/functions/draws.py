"""Random numbers from keys: the same for the same key, replicate and seed, wherever and in whatever order they are drawn.

Arithmetic is modulo a prime below 2**31, so that columns, NumPy and any SQL
engine with 64-bit integers give the same numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647
#: Multipliers of the steps.
A, B, C = 48_271, 69_621, 40_692


def key_number(key: Column, kind: str) -> Column:
    """A key as a whole number below :data:`PRIME`: whole numbers by themselves, others by the crc32 of their text; null is 0."""
    number = key.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.crc32(key.cast("string"))
    return F.coalesce(F.pmod(number, F.lit(PRIME)), F.lit(0)).cast("bigint")


def mixed(key, replicate, seed: int):
    """A whole number from 0 to :data:`PRIME` - 1, for columns and for arrays of 64-bit integers alike."""
    h = (key * A + (replicate + 1) * B + seed) % PRIME
    h = (h * h + h * C + seed) % PRIME
    h = (h * A + key + replicate) % PRIME
    return (h * h + h * B + 1) % PRIME


def unit(key: Column, replicate: Column, seed: int) -> Column:
    """A number strictly between 0 and 1."""
    return (mixed(key, replicate, seed) + F.lit(0.5)) / F.lit(float(PRIME))


def units(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(keys, replicates) of the same numbers as :func:`unit`."""
    return (mixed(keys.astype(np.int64)[:, None], np.arange(replicates, dtype=np.int64)[None, :], seed) + 0.5) / PRIME


def unit_sql(key: str, replicate: str, seed: int) -> str:
    """The same number as SQL."""
    h = f"(({key}) * {A} + (({replicate}) + 1) * {B} + {seed}) % {PRIME}"
    for step in (f"(h * h + h * {C} + {seed}) % {PRIME}", f"(h * {A} + ({key}) + ({replicate})) % {PRIME}", f"(h * h + h * {B} + 1) % {PRIME}"):
        h = step.replace("h ", f"({h}) ")
    return f"(({h}) + 0.5) / {PRIME}.0"


def poisson_times(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from uniforms, at most 12."""
    times, below, term = np.zeros(u.shape, np.int64), 0.0, np.exp(-1.0)
    for k in range(12):
        below += term
        times += u > below
        term /= k + 1
    return times


def poisson_edges() -> list[float]:
    """The uniforms beyond which :func:`poisson_times` counts one more."""
    edges, below, term = [], 0.0, float(np.exp(-1.0))
    for k in range(12):
        below += term
        edges.append(below)
        term /= k + 1
    return edges


def poisson_column(u: Column) -> Column:
    """The same count as a column."""
    times = F.lit(0)
    for edge in poisson_edges():
        times = times + (u > F.lit(edge)).cast("int")
    return times
