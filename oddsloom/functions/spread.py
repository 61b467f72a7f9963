"""Joins that no hot key puts into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to at most.
SALTS = 1024


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: str, salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key, without all rows of a key in one task.

    Rows are salted by ``by``. A key's row is repeated once for each salt that
    its rows have, so there are never more repetitions than rows, and a key with
    few rows has few. Null keys match nothing.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    present = salted.select(*keys, "__salt").distinct()
    return salted.join(present.join(keyed, keys), [*keys, "__salt"]).drop("__salt")
