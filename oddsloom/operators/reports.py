"""Reports over scored rows: arms, calibration, bands, grids and permutation tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsloom.functions import draws
from oddsloom.functions.spread import spread_join

#: Value blocks of a group in which percentiles are looked for.
PERCENTILE_BLOCKS = 4096


def total_and_groups(scored: DataFrame, group: str, measures: list[str], label: str = "all") -> DataFrame:
    """Counts and means over everything and by group; the row over everything is named ``label``."""
    by = scored.groupingSets([[], [F.col(group)]], F.col(group))
    out = by.agg(F.grouping(group).alias("__all"), F.count(F.lit(1)).alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in measures])
    return out.select(F.when(F.col("__all") == 1, label).otherwise(F.coalesce(F.col(group).cast("string"), F.lit("unknown"))).alias(group), "n", *measures)


def reliability_bins(scored: DataFrame, p: str, hit: str, key: list[str], bins: int = 10, by: str | None = None) -> DataFrame:
    """(bin, n, mean_p, hit_rate, gap): equal-count bins in order of p, ties by key.

    A rank is the row's place in its block, a range of p, plus the rows of lower blocks.
    """
    block = F.floor(F.col(p) * 1000).cast("int")
    rows = scored.withColumn("__b", block)
    sizes = rows.groupBy("__b").count().select(
        F.col("__b").alias("__bb"), F.coalesce(F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("count").over(W.partitionBy()).alias("__total")
    )
    rank = F.row_number().over(W.partitionBy("__b").orderBy(p, *key)) - 1
    ranked = rows.withColumn("__r", rank).join(sizes, F.col("__b").eqNullSafe(F.col("__bb"))).withColumn("__r", F.col("__r") + F.col("__before"))
    size, rest = F.floor(F.col("__total") / bins), F.col("__total") % bins
    bin_ = F.when(F.col("__r") < rest * (size + 1), F.floor(F.col("__r") / (size + 1))).otherwise(rest + F.floor((F.col("__r") - rest * (size + 1)) / F.greatest(size, F.lit(1))))
    out = ranked.groupBy((bin_ + 1).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("hit_rate")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): the bins' gaps weighted by their counts."""
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def arms_delta(a: DataFrame, b: DataFrame, key: list[str], measure: str) -> DataFrame:
    """(n, mean_a, mean_b, delta) of two arms over the same rows; rows in one arm alone fail the job."""
    both = a.select(*key, F.col(measure).alias("__a")).join(b.select(*key, F.col(measure).alias("__b")), key, "full")
    ok = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__a")).otherwise(F.raise_error(F.lit("the arms hold different rows")).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("mean_a"), F.avg("__b").alias("mean_b")).withColumn("delta", F.col("mean_a") - F.col("mean_b"))


def percentile_band(rows: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(by, low, high): exact percentiles with linear interpolation; null values are left out.

    Ranks are found in value blocks, so that no task holds a whole group: a
    coarse histogram of each group says in which blocks the wanted ranks lie,
    and only rows of those blocks are ordered, equal values as one row.
    """
    group = F.struct(F.lit(0).alias("_"), *by).alias("g")
    known = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("x"))
    ends = known.groupBy("g").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n"))
    width = F.greatest((F.col("most") - F.col("least")) / PERCENTILE_BLOCKS, F.lit(1e-300))
    blocked = spread_join(known, ends, ["g"], "x").select("g", "x", "n", F.floor((F.col("x") - F.col("least")) / width).alias("b"))
    values = blocked.groupBy("g", "n", "b", "x").agg(F.count(F.lit(1)).alias("c"))
    counts = values.groupBy("g", "n", "b").agg(F.sum("c").alias("m"))
    counts = counts.withColumn("before", F.sum("m").over(W.partitionBy("g").orderBy("b")) - F.col("m"))
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in (low, high)]
    wanted = [*[F.floor(a) for a in at], *[F.ceil(a) for a in at]]
    holds = reduce(lambda u, v: u | v, [(w >= F.col("before")) & (w < F.col("before") + F.col("m")) for w in wanted])
    inside = values.join(counts.where(holds).select("g", "b", "before"), ["g", "b"])
    ranked = inside.withColumn("last", F.sum("c").over(W.partitionBy("g", "b").orderBy("x")) + F.col("before"))

    def pick(w: Column) -> Column:
        return F.max(F.when((w >= F.col("last") - F.col("c")) & (w < F.col("last")), F.col("x")))

    found = ranked.groupBy("g", "n").agg(*[pick(w).alias(f"w{i}") for i, w in enumerate(wanted)])

    def between(i: int, a: Column) -> Column:
        return F.col(f"w{i}") + (a - F.floor(a)) * (F.col(f"w{i + 2}") - F.col(f"w{i}"))

    return found.select(*[F.col("g")[c].alias(c) for c in by], between(0, at[0]).alias("low"), between(1, at[1]).alias("high"))


def weighted_moments(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, mean, variance): weighted, the variance without a correction, from deviations."""
    w, x = F.col(weight), F.col(value)
    means = rows.groupBy(*by).agg(F.try_divide(F.sum(w * x), F.sum(w)).alias("mean"))
    dev = F.pow(x - F.col("mean"), F.lit(2.0))
    return rows.join(means, by).groupBy(*by, "mean").agg(F.try_divide(F.sum(w * dev), F.sum(w)).alias("variance"))


def grid_argmin(rows: DataFrame, grid: list[float], loss: Callable[[Column], Column]) -> DataFrame:
    """(grid_value, score, is_best): the mean of ``loss(grid value)`` for each grid value; the first least one is best.

    Losses of all grid values are made in one pass as columns and unpivoted after the aggregation.
    """
    means = rows.agg(*[F.avg(loss(F.lit(float(g)))).alias(f"__g{i}") for i, g in enumerate(grid)])
    flat = means.select(F.posexplode(F.array(*[F.struct(F.lit(float(g)).alias("grid_value"), F.col(f"__g{i}").alias("score")) for i, g in enumerate(grid)])).alias("i", "x")).select("i", "x.*")
    best = F.min(F.struct("score", "i")).over(W.partitionBy())["i"]
    return flat.select("grid_value", "score", (F.col("i") == best).alias("is_best"))


def _added_by_replicate(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], replicates: int, names: list[str]) -> DataFrame:
    """(replicate, names): the sums of ``part``'s (names, replicates) arrays; a task gives one row a replicate, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), replicates))
        for batch in batches:
            # Slices bound the (rows, replicates) array of draws.
            for at in range(0, batch.num_rows, 4096):
                total += part(batch.slice(at, 4096))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(x) for x in total]], ["replicate", *names])

    parts = rows.mapInArrow(run, ", ".join(["replicate int", *[f"{n} double" for n in names]]))
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_sums(rows: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, n, mean): means over Poisson-weighted resamples of groups, drawn from the group's key.

    A group's rows share their multiplicity, so that matches are resampled
    whole; draws depend on key, replicate and seed alone. Null values add
    nothing; without rows there are replicates of nothing.
    """
    number = draws.key_number(F.col(key), rows.schema[key].dataType.simpleString())
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("s"))

    def part(batch: pa.RecordBatch) -> np.ndarray:
        times = draws.poisson_times(draws.units(batch.column("key").to_numpy(), replicates, seed))
        return np.stack([batch.column("n").to_numpy() @ times, batch.column("s").to_numpy() @ times])

    sums = _added_by_replicate(totals.select(number.alias("key"), "n", "s"), part, replicates, ["n", "s"])
    return sums.select("replicate", F.col("n").cast("bigint").alias("n"), F.try_divide("s", "n").alias("mean"))


def resampled(rows: DataFrame, key: str, replicate: int, seed: int) -> DataFrame:
    """``rows`` with all rows of a key repeated as often as the bootstrap replicate draws that key, none included."""
    number = draws.key_number(F.col(key), rows.schema[key].dataType.simpleString())
    times = draws.poisson_column(draws.unit(number, F.lit(replicate).cast("bigint"), seed))
    return rows.withColumn("__nth", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).drop("__nth")


def permutation_test(pairs: DataFrame, key: str, difference: str, permutations: int, seed: int) -> DataFrame:
    """(observed, p_value): sign flips of paired differences; the share of flips at least as far from 0 as what was seen.

    A flip depends on key, permutation and seed alone. Null differences are left out.
    """
    number = draws.key_number(F.col(key), pairs.schema[key].dataType.simpleString())
    rows = pairs.where(F.col(difference).isNotNull()).select(number.alias("key"), F.col(difference).cast("double").alias("d"))

    def part(batch: pa.RecordBatch) -> np.ndarray:
        d = batch.column("d").to_numpy()
        sign = np.where(draws.units(batch.column("key").to_numpy(), permutations, seed) < 0.5, 1.0, -1.0)
        return np.stack([d @ sign, np.full(permutations, d.sum())])

    sums = _added_by_replicate(rows, part, permutations, ["flipped", "seen"]).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    # Sums of the same numbers in another order may differ in their last digits.
    far = F.abs("flipped") >= F.abs("seen") - 1e-9 * F.abs("seen")
    return sums.groupBy((F.try_divide("seen", "n")).alias("observed")).agg(F.avg(far.cast("double")).alias("p_value"))


def latest_name(rows: DataFrame, key: str, name: str, ts: str, tie: str) -> DataFrame:
    """(key, name) of the latest row, ties by ``tie``."""
    return rows.groupBy(key).agg(F.max_by(name, F.struct(ts, tie)).alias(name))
