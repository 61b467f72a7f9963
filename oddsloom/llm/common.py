"""What the operators share: folds, keys, bounded samples and one row of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of


def in_fold(doc_id: str | Column, of: int, remainder: int) -> Column:
    """Whether the id's fold is ``remainder``; false for a null id."""
    return F.coalesce(fold(doc_id, of) == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """``df``, or its ``most`` rows of smallest key hash: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), *[F.col(c) for c in df.columns]).limit(most)


def one_row_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with one row for each key, the first by its JSON text; rows with a null key stay as they are.

    Rows are reduced before they are shuffled, so a key that very many rows share is no large group.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    whole = F.struct(*df.columns)
    one = df.where(known).groupBy(*keys).agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__row.*")
    return one.unionByName(df.where(~known))
