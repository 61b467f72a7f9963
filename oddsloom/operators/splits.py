"""Chronological splits and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql import Window as W

from oddsloom.functions.guards import IntegrityError, positive_int, require_none, require_unique

MIN_TRAIN = 20


def numbered(matches: DataFrame, ts: str = "ts", key: str = "match_id") -> DataFrame:
    """``matches`` with ``nth`` from 0 in order of time and key, and ``total``.

    Rows are numbered day by day, each day in a task of its own; the window over
    everything runs over days.
    """
    day = F.to_date(ts).alias("__day")
    days = matches.groupBy(day).count()
    before = W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(F.col("__day").alias("__d"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"), F.sum("count").over(W.partitionBy()).alias("total"))
    within = W.partitionBy("__day").orderBy(ts, key)
    out = matches.withColumn("__day", F.to_date(ts)).withColumn("__n", F.row_number().over(within) - 1)
    return out.join(days, out["__day"].eqNullSafe(days["__d"])).withColumn("nth", F.col("__n") + F.col("__before")).drop("__day", "__d", "__n", "__before")


def chronological_split(matches: DataFrame, test_share: float = 0.15, ts: str = "ts", key: str = "match_id", check: bool = True) -> DataFrame:
    """(key, ts, split): the last max(1, share of all, half to even) rows are test, the others train.

    With ``check``, null times, repeated keys and fewer than twenty train rows
    fail; these checks are three jobs over the keys and times of ``matches``.
    """
    if check:
        require_none(matches, F.col(ts).isNull(), [key], "matches without a time")
        require_unique(matches, [key], "matches")
        n = matches.count()
        test = max(1, round(n * test_share))
        if n - test < MIN_TRAIN:
            raise IntegrityError(f"{n - test} train rows; {MIN_TRAIN} are needed")
    rows = numbered(matches, ts, key)
    size = F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(float(test_share)), 0).cast("bigint"))
    return rows.select(key, ts, F.when(F.col("nth") >= F.col("total") - size, "test").otherwise("train").alias("split"))


def walk_forward_folds(train: DataFrame, folds: int, min_block: int = 1, ts: str = "ts", key: str = "match_id") -> DataFrame:
    """(fold_id, key, role): fold f trains on blocks 0..f and validates on block f + 1 of folds + 1 chronological blocks.

    The first block takes the remainder; folds are fewer if a block would be
    smaller than ``min_block``.
    """
    positive_int(folds, "folds"), positive_int(min_block, "min_block")
    n = train.count()
    folds = min(folds, n // min_block - 1)
    if folds < 1:
        raise IntegrityError(f"{n} rows make no fold")
    size = n // (folds + 1)
    first = n - size * folds
    rows = numbered(train, ts, key)
    block = F.when(F.col("nth") < first, 0).otherwise(F.floor((F.col("nth") - first) / size) + 1).cast("int")
    rows = rows.select(key, block.alias("__block")).withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("__block") <= F.col("fold_id"), "train").when(F.col("__block") == F.col("fold_id") + 1, "validate")
    return rows.select("fold_id", key, role.alias("role")).where("role is not null")


@dataclass(frozen=True)
class FoldBounds:
    """Chronological blocks by the (time, key) of their first matches; ``end`` is where the train matches stop, if they do.

    Block 0 is for training alone; fold f trains on blocks 0..f and validates on block f + 1.
    """

    starts: tuple[tuple[str, object], ...]
    end: tuple[str, object] | None
    kind: Ty.DataType

    @property
    def folds(self) -> int:
        return len(self.starts) - 1

    def block(self, ts: Column, key: Column) -> Column:
        """The block of a row by its match's time and key, without a join; null from ``end`` on and for a null time."""

        def from_(bound: tuple[str, object]) -> Column:
            at = F.lit(bound[0]).cast(self.kind)
            return (ts > at) | ((ts == at) & (key >= F.lit(bound[1])))

        number = F.lit(0)
        for bound in self.starts[1:]:
            number = number + from_(bound).cast("int")
        return F.when(ts.isNotNull() if self.end is None else ~from_(self.end), number)


def fold_bounds(split: DataFrame, folds: int = 5, min_block: int = 8, ts: str = "ts", key: str = "match_id") -> FoldBounds:
    """The blocks of the train matches of a chronological split (key, ts, split), as :func:`walk_forward_folds` makes them.

    To the driver come the first matches of the blocks, folds + 2 at most.
    """
    positive_int(folds, "folds"), positive_int(min_block, "min_block")
    n = split.where("split = 'train'").count()
    folds = min(folds, n // min_block - 1)
    if folds < 1:
        raise IntegrityError(f"{n} rows make no fold")
    size = n // (folds + 1)
    places = [0, *[n - size * (folds - i) for i in range(folds)], n]
    at = numbered(split.select(key, ts), ts, key).where(F.col("nth").isin(places)).select("nth", F.col(ts).cast("string").alias("t"), F.col(key).alias("k"))
    found = {r["nth"]: (r["t"], r["k"]) for r in at.collect()}
    return FoldBounds(tuple(found[i] for i in places[:-1]), found.get(n), split.schema[ts].dataType)


def assemble_out_of_fold(folds: DataFrame, predictions: DataFrame, key: str = "match_id") -> DataFrame:
    """``predictions`` (fold_id, key, ...), checked to cover exactly the validation rows of every fold."""
    want = folds.where("role = 'validate'").select("fold_id", key)
    missing = want.join(predictions, ["fold_id", key], "left_anti")
    extra = predictions.join(want, ["fold_id", key], "left_anti")
    for what, rows in (("lack", missing), ("do not belong to", extra)):
        some = rows.select("fold_id", key).limit(5).collect()
        if some:
            raise IntegrityError(f"predictions {what} {[tuple(r) for r in some]}")
    return predictions.select("fold_id", *[c for c in predictions.columns if c != "fold_id"])


def join_split(maps: DataFrame, splits: DataFrame, key: str = "match_id") -> DataFrame:
    """``maps`` with the split of their match, and what other columns of ``splits`` they lack; a match without one fails, which a job over both tables' keys finds out."""
    some = maps.join(splits, key, "left_anti").select(key).distinct().limit(5).collect()
    if some:
        raise IntegrityError(f"no split for {[r[0] for r in some]}")
    return maps.join(splits.select(key, *[c for c in splits.columns if c not in maps.columns]), key)
