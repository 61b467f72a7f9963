"""Exact top-k search by inner product: vectors in buckets of like length, pruned bucket by bucket, then verified.

A vector's product with a query is its length times the query's length times
their cosine. A query that has k products already needs a cosine of at least
(k-th product / both lengths) from a bucket: above 1 the bucket is not read at
all; if it is high, only vectors whose largest coordinates lie in the interval
that such a cosine allows are looked at; if not, those that are long enough. What
is left is verified by exact whole-number products. Bounds only ever prune what
is strictly worse, so ties are all seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from oddsloom.llm import intvec
from oddsloom.session import Scratch


@dataclass(frozen=True)
class TopkConfig:
    """``k`` products a query; components are floor(scale * x). Lengths in a bucket differ by ``ratio`` at most, and buckets
    are cut into blocks of about ``block_rows`` vectors. ``seeds`` vectors, the longest, give every query its first bound. ``focus`` coordinates
    are tried by the coordinate pruning, which is taken from the cosine on at which it leaves fewer than one of ``gain``
    vectors (measured with ``trials`` vectors of the block). A task goes through ``queries`` queries at a time."""

    k: int = 5
    scale: int = 256
    ratio: float = 0.9
    block_rows: int = 16_384
    seeds: int = 2048
    focus: int = 6
    gain: int = 8
    trials: int = 16
    queries: int = 256


#: Cosines tried for the switch between the prunings, and the room left for rounding.
_COSINES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
_SLACK = 1e-9


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))


def best_of(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((vec_id, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


class Block:
    """Vectors of like length, longest first, with each coordinate of their directions sorted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, config: TopkConfig):
        norm = _norms(vectors)
        order = np.lexsort((ids, -norm))
        self.ids, self.vectors, self.norm, self.config = ids[order], vectors[order], norm[order], config
        self.longest = float(self.norm[0])
        self.direction = self.vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.by_coordinate = np.argsort(self.direction, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.direction, self.by_coordinate, 0)
        self.switch = self._switch()

    def _switch(self) -> float:
        """The least cosine from which coordinates prune to less than 1 in ``gain``; beyond 1 if none does."""
        tried = self.direction[:: max(1, len(self.ids) // self.config.trials)][: self.config.trials]
        for cosine in _COSINES:
            if np.mean([len(self.by_coordinates(q, cosine)) for q in tried]) * self.config.gain <= len(self.ids):
                return cosine
        return 2.0

    def by_coordinates(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose direction may have at least ``cosine`` (above 0) with ``direction``, by the largest coordinates of that."""
        focus = np.argsort(-np.abs(direction))[: self.config.focus]
        low, high = self.interval(direction[focus], cosine)
        a = np.array([np.searchsorted(self.sorted[:, f], x, "left") for f, x in zip(focus, low, strict=True)])
        b = np.array([np.searchsorted(self.sorted[:, f], x, "right") for f, x in zip(focus, high, strict=True)])
        least = int(np.argmin(b - a))
        rows = self.by_coordinate[a[least] : b[least], focus[least]]
        near = self.direction[rows[:, None], focus]
        return rows[((near >= low) & (near <= high)).all(axis=1)]

    @staticmethod
    def interval(q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest coordinate of a unit vector with at least ``cosine`` to one that has ``q`` there."""
        wide = np.sqrt(np.maximum(0.0, 1 - q * q) * max(0.0, 1 - cosine * cosine))
        low = np.where(q <= -cosine, -1.0, q * cosine - wide)
        high = np.where(q >= cosine, 1.0, q * cosine + wide)
        return low - 1e-7, high + 1e-7

    def search(self, asked: np.ndarray, vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of each query's best, of those with at least its bound (-inf: none yet)."""
        norm, none = _norms(vectors), np.iinfo(np.int64).min
        cosine = np.full(len(asked), -np.inf)
        np.divide(bound, norm * self.longest, out=cosine, where=norm * self.longest > 0)
        # Without a length on either side all products are 0.
        cosine = np.where((norm * self.longest == 0) & (bound > 0), np.inf, cosine) - _SLACK
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        live = cosine <= 1
        few = live & (cosine >= self.switch)
        for i in np.flatnonzero(few):
            rows = self.by_coordinates(vectors[i] / norm[i], float(cosine[i]))
            found.append((np.full(len(rows), i), rows, intvec.products(vectors[i : i + 1], self.vectors[rows])[0]))
        many = np.flatnonzero(live & ~few)
        if len(many):
            # Of vectors in falling order of length, those that one of these queries still needs.
            least = np.full(len(many), -np.inf)
            np.divide(bound[many], norm[many], out=least, where=norm[many] > 0)
            n = int(np.searchsorted(-self.norm, -(least.min() * (1 - _SLACK) - _SLACK), "right"))
            d = intvec.products(vectors[many], self.vectors[:n])
            d[self.ids[:n] == asked[many, None]] = none
            # As good as the k-th best of its row.
            kth = np.partition(d, n - self.config.k, axis=1)[:, n - self.config.k, None] if n > self.config.k else none
            r, j = np.nonzero((d >= kth) & (d > none))
            found.append((many[r], j, d[r, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = self.ids[j]
        keep = (ids != asked[i]) & (s >= bound[i])
        i, ids, s = i[keep], ids[keep], s[keep]
        best = best_of(i, ids, s, self.config.k)
        return asked[i[best]], ids[best], s[best]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Index:
    """``blocks`` has (block, dim, ids, vectors), one row a block; ``buckets`` has, by number of components, (first block, longest
    length) from the longest bucket down, then the number of blocks after the last; ``seeds`` the ids and vectors of the first bounds."""

    blocks: DataFrame
    buckets: dict[int, list[tuple[int, float]]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]
    scratch: Scratch


def _usable(df: DataFrame, config: TopkConfig, id_col: str, vector_col: str) -> DataFrame:
    rows = df.where(intvec.all_finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), intvec.scaled(F.col(vector_col), config.scale).alias("q"))


def build_index(df: DataFrame, config: TopkConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """The vectors of ``df`` in blocks, by number of components and length.

    Vectors that are null, empty or hold a null or non-finite component take no
    part, nor do rows without an id; all others do, repeated ones as often. An
    empty table gives no blocks; other columns, of any name, are not looked at.
    Components beyond 2^24 after scaling fail the job. To the driver come one
    row for each bucket (a few hundred at most for each number of components)
    and the seeds.
    """
    config = config or TopkConfig()
    scratch = Scratch(df.sparkSession, "topk")
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = _usable(df, config, id_col, vector_col).withColumns({"dim": F.size("q"), "square": square})
    bucket = F.when(F.col("square") > 0, F.floor(F.log("square") / F.lit(-2 * np.log(config.ratio)))).otherwise(F.lit(-1)).cast("int")
    rows = scratch.written(rows.withColumn("bucket", bucket), "rows")
    counts = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top")).orderBy("dim", F.desc("bucket")).collect()
    buckets: dict[int, list[tuple[int, float]]] = {}
    places, first = [], 0
    for r in counts:
        blocks = -(-r["n"] // config.block_rows)
        buckets.setdefault(r["dim"], []).append((first, float(np.sqrt(r["top"]))))
        places.append((r["dim"], r["bucket"], first, blocks))
        first += blocks
    ends = {dim: max(f + b for d, _, f, b in places if d == dim) for dim in buckets}
    for dim, end in ends.items():
        buckets[dim].append((end, -1.0))
    seeds: dict[int, list] = {}
    for r in intvec.smallest(rows.select("vec_id", "q", "dim", "square"), config.seeds, F.desc("square"), F.col("vec_id"), F.col("q")):
        seeds.setdefault(r["dim"], []).append((r["vec_id"], r["q"]))
    placed = df.sparkSession.createDataFrame(places, "dim int, bucket int, first int, blocks int")
    dealt = rows.join(F.broadcast(placed), ["dim", "bucket"]).select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int").alias("block"), "dim", "vec_id", "q")
    packed = dealt.groupBy("block").applyInArrow(_pack, "block int, dim int, ids binary, vectors binary")
    at = {dim: (np.array([v for v, _ in s], np.int64), np.array([q for _, q in s], np.int64)) for dim, s in seeds.items()}
    index = Index(scratch.written(packed, "blocks"), buckets, at, scratch)
    scratch.drop("rows")
    return index


def _pack(table: pa.Table) -> pa.Table:
    dim = table["dim"][0].as_py()
    vectors = intvec.matrix(table["q"].combine_chunks(), dim, np.int32)
    return pa.table({"block": table["block"][:1], "dim": table["dim"][:1], "ids": [table["vec_id"].to_numpy().astype(np.int64).tobytes()], "vectors": [vectors.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))


def _ask(batches: Iterator[pa.RecordBatch], index: Index, config: TopkConfig) -> Iterator[pa.RecordBatch]:
    """Queries with their first bound and the blocks that may hold something as good."""
    for batch in batches:
        asked, vectors = batch.column("vec_id").to_numpy(), batch.column("q")
        size = vectors.value_lengths().to_numpy()
        bound, blocks = np.full(len(size), -np.inf), np.zeros((len(size), 2), np.int64)
        for dim in np.unique(size).tolist():
            if dim not in index.buckets:
                continue
            rows = np.flatnonzero(size == dim)
            x = intvec.matrix(vectors.take(pa.array(rows)), dim)
            if dim in index.seeds:
                ids, seeds = index.seeds[dim]
                d = intvec.products(x, seeds).astype(np.float64)
                d[ids == asked[rows, None]] = -np.inf
                if len(ids) >= config.k:
                    bound[rows] = np.partition(d, len(ids) - config.k, axis=1)[:, len(ids) - config.k]
            first = np.array([f for f, _ in index.buckets[dim]])
            longest = np.array([m for _, m in index.buckets[dim][:-1]])
            needed = (longest * _norms(x)[:, None] * (1 + _SLACK) + _SLACK >= bound[rows, None]).sum(axis=1)
            blocks[rows, 0], blocks[rows, 1] = first[0], first[needed]
        visits = [list(range(a, b)) for a, b in blocks.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(bound), pa.array(visits, pa.list_(pa.int32()))], ["vec_id", "q", "bound", "blocks"])


def _walk(batches: Iterator[pa.RecordBatch], config: TopkConfig) -> Iterator[pa.RecordBatch]:
    """Blocks, each followed by its queries, in one sorted stream: a task holds one block and some queries."""
    block: Block | None = None
    number, dim = -1, 0
    waiting: list[tuple[int, bytes, float]] = []

    def answers() -> pa.RecordBatch:
        vectors = np.frombuffer(b"".join(v for _, v, _ in waiting), np.int32).reshape(-1, dim).astype(np.int64)
        found = block.search(np.array([q for q, _, _ in waiting], np.int64), vectors, np.array([b for _, _, b in waiting]))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], schema=_FOUND)

    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                if waiting:
                    yield answers()
                number, dim = row["block"], row["dim"]
                block = Block(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(-1, dim).astype(np.int64), config)
            elif row["block"] == number:
                waiting.append((row["vec_id"], row["vectors"], row["bound"]))
                if len(waiting) == config.queries:
                    yield answers()
    if waiting:
        yield answers()


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.asarray(v, np.int32).tobytes() for v in batch.column("q").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vectors, pa.binary()), batch.column("bound"), batch.column("blocks")], ["vec_id", "vectors", "bound", "blocks"])


def search(index: Index, queries: DataFrame, config: TopkConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest products, highest first, ties to the smaller id.

    Candidates are all rows but those of the query's own id, and only vectors of
    as many components. Queries that take no part find nothing; of queries that
    repeat an id, the smallest vector counts. A query with fewer candidates than
    ``k`` gets them all. A block of the index is read once and the queries that
    may find something there stream past it.
    """
    config = config or TopkConfig()
    asked = _usable(queries, config, id_col, vector_col).groupBy("vec_id").agg(F.min("q").alias("q"))
    plain = Index(None, index.buckets, index.seeds, None)
    asked = asked.mapInArrow(lambda b: _as_bytes(_ask(b, plain, config)), "vec_id long, vectors binary, bound double, blocks array<int>")
    asked = asked.select(F.explode("blocks").alias("block"), "vec_id", "vectors", "bound")
    rows = index.blocks.withColumns({"vec_id": F.lit(None).cast("long"), "bound": F.lit(None).cast("double")}).unionByName(asked.withColumns({"dim": F.lit(None).cast("int"), "ids": F.lit(None).cast("binary")}))
    stream = rows.repartition("block").sortWithinPartitions("block", F.col("vec_id").asc_nulls_first())
    found = stream.mapInArrow(lambda b: _walk(b, config), T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")]))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")


def top_products(df: DataFrame, queries: DataFrame, config: TopkConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Build the index of ``df`` and search it for ``queries``."""
    return search(build_index(df, config, id_col, vector_col), queries, config, id_col, vector_col)
