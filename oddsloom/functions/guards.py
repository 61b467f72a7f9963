"""Integrity checks that fail a job instead of dropping rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Rows that break a rule of the data model."""


def require_columns(df: DataFrame, columns: list[str], table: str) -> None:
    """KeyError naming the columns that ``df`` lacks; looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{table} lacks columns {missing}")


def require_unique(df: DataFrame, keys: list[str], table: str) -> None:
    """IntegrityError naming some repeated keys."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if repeated:
        raise IntegrityError(f"{table} repeats {keys}: {[tuple(r)[:-1] for r in repeated]}")


def require_none(df: DataFrame, bad: Column, keys: list[str], what: str) -> None:
    """IntegrityError naming some rows for which ``bad`` holds."""
    rows = df.where(bad).select(*keys).limit(5).collect()
    if rows:
        raise IntegrityError(f"{what}: {[tuple(r) for r in rows]}")


def checked(value: Column, ok: Column, message: str, kind: str) -> Column:
    """``value``, or a failing job where ``ok`` does not hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def positive(value: float, name: str) -> float:
    """A finite number above zero; booleans are refused."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be a positive finite number, not {value!r}")
    return float(value)


def positive_int(value: int, name: str) -> int:
    """A whole number above zero; booleans are refused."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return value


def within(value: float, low: float, high: float, name: str) -> float:
    """A number from ``low`` to ``high``."""
    if isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], not {value!r}")
    return float(value)
