"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into hash blocks, which stand in a permuted order. A
source's target gives its quota of draws: whole passes over all its blocks, then
the first blocks of the order, then at most one part of a block and one single
document. A binary tree over the output shards splits these exact quotas: each
node draws, without replacement, how many units of each source go to its left
half. A shard takes the next units of each source's order, so that no two shards
share one, and orders its rows by a local random key. A document is in the mix
as often as the shards of the tree hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsloom.functions.spread import spread_join
from oddsloom.session import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Tables of sources or blocks of at most so many rows are broadcast; larger ones are joined by a shuffle, to the same rows.
BROADCAST_ROWS = 80_000


@dataclass(frozen=True)
class MixConfig:
    """Weights by rank of the source, repeating; share of all words to take; most copies of a document.

    A source has ``blocks`` blocks, or one for every ``block_rows`` documents if
    that is more. A tree splits the quotas of ``tree_sources`` sources.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    blocks: int = 1024
    block_rows: int = 4096
    shards: int = 16
    tree_sources: int = 1000
    seed: int = 20_240_607


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, config: MixConfig) -> DataFrame:
    """(source, source_size, target) for a table with one row (source, source_size) per source.

    Sources rank by code point, null last, and take the weights in turn. A
    target is weight x level, stopped at ``most`` x size; the level is the one
    at which the targets add up to the share. Handing on again and again what
    stopped sources leave ends at that level too. The windows run over one row
    for each source, not over documents.
    """
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    ranked = sources.withColumn("__rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("__w", F.element_at(weights, (F.pmod(F.col("__rank") - 1, F.lit(len(config.weights))) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("source_size") * float(config.most))
    by_level = W.orderBy(F.col("__cap") / F.col("__w"), "__rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = (
        ranked.withColumn("__c", F.coalesce(F.sum("__cap").over(by_level), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(by_level), F.lit(0.0)))
        .withColumn("__all", F.sum("source_size").over(everything) * float(config.share))
    )
    level = F.max((F.col("__all") - F.col("__c")) / F.col("__left")).over(everything)
    return ranked.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("__w") * level, F.col("__cap")))).select("source", "source_size", "target")


def split_quotas(units: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block quotas that add up to ``units`` exactly, by a binary splitting tree over the shards."""
    out = np.zeros((shards, len(units)), np.int64)
    stack = [(0, shards, units.astype(np.int64))]
    while stack:
        a, b, quota = stack.pop()
        if b - a == 1:
            out[a] = quota
            continue
        middle = (a + b) // 2
        draw = int(quota.sum()) * (middle - a) // (b - a)
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(quota, draw, method="marginals") if draw else np.zeros_like(quota)
        stack += [(a, middle, left), (middle, b, quota - left)]
    return out


def shard_ranges(units: DataFrame, config: MixConfig) -> DataFrame:
    """(key, shard, first, n): which run of a source's units each shard takes; ``units`` has (key, part, units).

    Sources of one part share a tree, which runs in a task of its own; the
    driver holds none of them.
    """

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        quotas = split_quotas(table["units"].to_numpy(), config.shards, config.seed)
        ends = np.cumsum(quotas, axis=0)
        keys = pa.chunked_array([table["key"].combine_chunks()] * config.shards)
        shard = np.repeat(np.arange(config.shards, dtype=np.int32), table.num_rows)
        return pa.table({"key": keys, "shard": shard, "first": (ends - quotas).reshape(-1), "n": quotas.reshape(-1)})

    return units.select("key", "part", "units").groupBy("part").applyInArrow(split, "key string, shard int, first long, n long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def block_of(doc_id: Column, blocks: Column, config: MixConfig) -> Column:
    """The document's block within its source of so many blocks."""
    return F.pmod(F.xxhash64(F.lit(config.seed), doc_id), blocks).cast("long")


def order_of(doc_id: Column, config: MixConfig) -> Column:
    """The document's place within its block, as a number to sort by."""
    return F.xxhash64(F.lit(config.seed + 1), doc_id)


def _with_source(rows: DataFrame, sources: DataFrame, n: int, by: str) -> DataFrame:
    """``rows`` with their source's columns, by ``key``; the rows of a hot source stay where they are, or are spread."""
    return rows.join(F.broadcast(sources), "key") if n <= BROADCAST_ROWS else spread_join(rows, sources, ["key"], by)


@dataclass
class Mix:
    """A plan: ``sources`` has one row per source with size, target and number of blocks.

    ``drawn`` has one row per unit that a shard holds: (key, block, pass, shard,
    upto, only). ``upto`` is the last place within the block that belongs to
    it, null for all; ``only`` is the id of a single document, null for all.
    """

    config: MixConfig
    sources: DataFrame
    n_sources: int
    drawn: DataFrame
    n_drawn: int


def _quotas(placed: DataFrame, ranked: DataFrame, sources: DataFrame, config: MixConfig) -> DataFrame:
    """``sources`` with the parts of their quota.

    A pass takes whole blocks while they fit, then documents of the next block
    while they fit, then the one document left whose size comes nearest to what
    is missing, if that is nearer than none.
    """
    share = sources.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    share = share.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("open", F.col("full") < config.most)
    sums = ranked.join(share.select("key", "rest"), "key").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("upto_here") <= F.col("rest")).alias("whole"),
        F.coalesce(F.max(F.when(F.col("upto_here") <= F.col("rest"), F.col("upto_here"))), F.lit(0)).alias("before"),
    )
    share = durable(share.join(sums, "key").withColumn("whole", F.when(F.col("open"), F.col("whole")).otherwise(0)))
    cut = share.where("open").select("key", "rest", "whole", "before")
    small = cut.count() <= BROADCAST_ROWS
    rows = placed.join(F.broadcast(cut), "key") if small else spread_join(placed, cut, ["key"], "doc_id")
    # The rows of one block are all that a window sees.
    inside = rows.where(F.col("rank") == F.col("whole")).withColumn("sum", F.sum("size").over(W.partitionBy("key").orderBy("place")) + F.col("before"))
    part = inside.where(F.col("sum") <= F.col("rest")).groupBy("key").agg(F.max("place").alias("upto"), F.max("sum").alias("got"))
    share = durable(share.join(part, "key", "left").withColumn("gap", F.col("rest") - F.coalesce("got", "before")))
    left = share.where("open").select("key", "whole", "upto", "gap")
    rows = placed.join(F.broadcast(left), "key") if small else spread_join(placed, left, ["key"], "doc_id")
    untaken = (F.col("rank") > F.col("whole")) | ((F.col("rank") == F.col("whole")) & ~F.coalesce(F.col("place") <= F.col("upto"), F.lit(False)))
    miss = F.abs(F.col("size") - F.col("gap"))
    single = rows.where(untaken & (miss < F.col("gap")) & F.col("doc_id").isNotNull()).groupBy("key").agg(F.min_by(F.struct("doc_id", "rank"), F.struct(miss, "place", "doc_id")).alias("single"))
    out = share.join(single, "key", "left").select("*", F.col("single.doc_id").alias("only"), F.col("single.rank").alias("only_rank")).drop("single")
    passes = F.col("full") * F.col("n_blocks") + F.col("whole")
    return out.withColumn("passes", passes).withColumn("units", passes + F.col("upto").isNotNull().cast("int") + F.col("only").isNotNull().cast("int"))


def plan_mix(docs: DataFrame, config: MixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Mix, DataFrame]:
    """The plan for ``docs`` and the table (doc_id, source, size, key) that it was made from."""
    config = config or MixConfig()
    sizes = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), source_key(F.col(source_col)).alias("key")))
    totals = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    blocks = totals.select("source", F.greatest(F.lit(config.blocks), F.ceil(F.col("rows") / config.block_rows)).cast("long").alias("blocks"))
    targets = source_targets(totals.select("source", "source_size"), config).join(blocks.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sources = durable(targets.withColumn("key", source_key(F.col("source"))))
    n_sources = sources.count()

    dealt = _with_source(sizes, sources.select("key", "blocks"), n_sources, "doc_id")
    dealt = dealt.select("doc_id", "size", "key", block_of(F.col("doc_id"), F.col("blocks"), config).alias("block"), order_of(F.col("doc_id"), config).alias("place"))
    words = dealt.groupBy("key", "block").agg(F.sum("size").alias("words"))
    order = W.partitionBy("key").orderBy(F.xxhash64(F.lit(config.seed + 2), "block"), "block")
    ranked = durable(words.select("key", "block", (F.row_number().over(order) - 1).cast("long").alias("rank"), F.sum("words").over(order).alias("upto_here")))
    n_blocks = ranked.count()
    ranks = ranked.select("key", "block", "rank")
    placed = dealt.join(F.broadcast(ranks) if n_blocks <= BROADCAST_ROWS else ranks, ["key", "block"])
    quotas = durable(_quotas(placed, ranked, sources, config).withColumn("part", F.floor((F.row_number().over(W.orderBy("key")) - 1) / config.tree_sources)))

    taken = shard_ranges(quotas.where("units > 0"), config).where("n > 0")
    nth = taken.select("key", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("nth"))
    nth = nth.join(quotas.select("key", "full", "n_blocks", "whole", "passes", "upto", "only", "only_rank"), "key")
    regular, partly = F.col("nth") < F.col("passes"), (F.col("nth") == F.col("passes")) & F.col("upto").isNotNull()
    units = nth.select(
        "key", "shard",
        F.when(regular, F.col("nth") % F.col("n_blocks")).when(partly, F.col("whole")).otherwise(F.col("only_rank")).alias("rank"),
        F.when(regular, F.floor(F.col("nth") / F.col("n_blocks"))).otherwise(F.col("full")).cast("int").alias("pass"),
        F.when(~regular & partly, F.col("upto")).alias("upto"), F.when(~regular & ~partly, F.col("only")).alias("only"),
    )
    drawn = durable(units.join(ranks, ["key", "rank"]).select("key", "block", "pass", "shard", "upto", "only"))
    return Mix(config, sources, n_sources, drawn, drawn.count()), sizes


def deal(mix: Mix, rows: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``rows`` as often as the shards of the tree hold them, with ``mix_pass``, ``mix_shard`` and ``mix_order`` (a local random key).

    A null id is hashed like any other value; rows that repeat an id within a source are dealt alike.
    """
    keyed = rows.withColumn("key", source_key(F.col(source_col)))
    keyed = _with_source(keyed, mix.sources.select("key", "blocks"), mix.n_sources, id_col)
    keyed = keyed.withColumn("block", block_of(F.col(id_col), F.col("blocks"), mix.config))
    held = keyed.join(F.broadcast(mix.drawn) if mix.n_drawn <= BROADCAST_ROWS else mix.drawn, ["key", "block"])
    inside = F.coalesce(order_of(F.col(id_col), mix.config) <= F.col("upto"), F.lit(True)) & F.coalesce(F.col(id_col) == F.col("only"), F.col("only").isNull())
    return held.where(inside).select(*rows.columns, F.col("pass").alias("mix_pass"), F.col("shard").alias("mix_shard"), F.xxhash64(F.lit(mix.config.seed + 3), id_col, "pass").alias("mix_order"))


def laid_out(mixed: DataFrame) -> DataFrame:
    """``mixed`` shard by shard, each in its local order; a large shard spans several partitions, cut by ranges of that order."""
    return mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def taken_words(mix: Mix, sizes: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``sizes``: the words that the shards of the mix hold of it.

    The mix is dealt, laid out and stored with ids in place of texts, and then
    counted; rows that repeat an id within a source are counted once a pass.
    """
    mixed = durable(laid_out(deal(mix, sizes.select("doc_id", "source", F.col("key").alias("own")))))
    copies = mixed.groupBy("own", "doc_id", "mix_pass").agg(F.lit(1).alias("n"))
    copies = copies.groupBy(F.col("own").alias("__own"), F.col("doc_id").alias("__id")).agg(F.count("n").alias("__copies"))
    out = sizes.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__own")), "left")
    out = _with_source(out, mix.sources.select("key", "source_size", "target"), mix.n_sources, "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("__copies", F.lit(0))).alias("taken"))


def mix_sources(docs: DataFrame, config: MixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated as drawn, with ``mix_shard`` and ``mix_order`` (a local random key).

    Columns of these two names are replaced; any other name may be there. To
    write it: ``laid_out(out)``. A null text has no words and stays where its
    block is taken; a null source is a source; rows that repeat an id within a
    source are drawn alike; an empty table gives an empty mix. The same rows and
    seed give the same mix, however they are partitioned.
    """
    mix, _ = plan_mix(docs, config, id_col, text_col, source_col)
    kept = [c for c in docs.columns if c not in ("mix_shard", "mix_order")]
    rows = docs.select(F.struct(*kept).alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__src"))
    return deal(mix, rows, "__id", "__src").select("__row.*", "mix_shard", "mix_order")
