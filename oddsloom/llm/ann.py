"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to the nearest of a few centroids, and those of a centroid to
shards by hash. A query goes to the shards of its nearest centroids alone; how
many these must be is measured on the sample that the centroids are fitted on,
so vectors that lie in no clusters are searched in all shards. A shard's graph is stored as flat
neighbour arrays, one for each level; it is built in bulk from blocked distance
products, with the usual neighbour selection that keeps an edge only if no
nearer kept neighbour is closer to its end. A query descends greedily through
the upper levels and keeps a beam at the lowest one; all queries of a block
walk in step. Every shard gives its best, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from oddsloom.session import durable


@dataclass(frozen=True)
class AnnConfig:
    """``links`` neighbours a node (twice that at the lowest level), ``pool`` candidates to choose them from,
    ``beam`` nodes kept in a search, ``shard_rows`` vectors a shard and ``block`` queries a task.

    Up to ``centroids`` centroids are fitted on at most ``fit_rows`` vectors; a query visits the fewest of them that
    hold the part ``cover`` of the true neighbours of ``trials`` of these vectors."""

    k: int = 10
    links: int = 20
    pool: int = 48
    beam: int = 160
    shard_rows: int = 8192
    block: int = 1024
    centroids: int = 256
    fit_rows: int = 20_000
    cover: float = 0.98
    trials: int = 200
    seed: int = 17


def nearest_among(vectors: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) nearest others of every vector and their squared distances, by blocks of one product."""
    n = len(vectors)
    k = min(k, n - 1)
    norm = np.einsum("ij,ij->i", vectors, vectors)
    index, distance = np.zeros((n, k), np.int32), np.zeros((n, k), np.float32)
    for a in range(0, n, block):
        d = norm[a : a + block, None] + norm - 2 * (vectors[a : a + block] @ vectors.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
        own = np.take_along_axis(d, best, 1)
        order = np.argsort(own, axis=1)
        index[a : a + block], distance[a : a + block] = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
    return index, distance


def choose_links(vectors: np.ndarray, index: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """(n, most) chosen neighbours, -1 where there are fewer: each is nearer to its node than to any chosen before it.

    Places left over go to the nearest of those passed over, so that no node is badly connected.
    """
    n, k = index.shape
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        ok = chosen.sum(axis=1) < most
        for i in range(j):
            both = ok & chosen[:, i]
            if both.any():
                rows = np.flatnonzero(both)
                gap = vectors[index[rows, j]] - vectors[index[rows, i]]
                ok[rows] &= np.einsum("ij,ij->i", gap, gap) > distance[rows, j]
        chosen[:, j] = ok
    rank = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1, np.int32)
    out[:, : rank.shape[1]] = np.take_along_axis(index, rank, 1)
    return out


def with_reverse(links: np.ndarray, distance_of, most: int) -> np.ndarray:
    """Links made mutual: each node also takes the nearest of those that link to it, up to ``most``."""
    n = len(links)
    source = np.repeat(np.arange(n), links.shape[1])
    target = links.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    pair = np.unique(a.astype(np.int64) * n + b)
    a, b = pair // n, pair % n
    order = np.lexsort((distance_of(a, b), a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    keep = nth < most
    out = np.full((n, most), -1, np.int32)
    out[a[keep], nth[keep]] = b[keep]
    return out


@dataclass
class Graph:
    """``levels`` from the lowest up: node numbers in ascending order, and their flat neighbour array."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, vectors: np.ndarray, config: AnnConfig) -> Graph:
        rng = np.random.default_rng(config.seed)
        height = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(config.links)).astype(int)
        height[:1] = max(1, height.max(initial=1))
        levels = []
        for level in range(int(height.max(initial=0)) + 1):
            nodes = np.flatnonzero(height >= level).astype(np.int32)
            own = vectors[nodes]
            most = config.links * (2 if level == 0 else 1)
            if len(nodes) == 1:
                levels.append((nodes, np.full((1, most), -1, np.int32)))
                continue
            index, distance = nearest_among(own, config.pool)
            links = choose_links(own, index, distance, config.links)
            links = with_reverse(links, lambda a, b, v=own: np.einsum("ij,ij->i", v[a] - v[b], v[a] - v[b]), most)
            levels.append((nodes, np.where(links >= 0, nodes[links], -1)))
        return cls(vectors, levels)

    def _distance(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - queries[:, None, :]
        return np.einsum("qnd,qnd->qn", gap, gap)

    def search(self, queries: np.ndarray, k: int, beam: int) -> np.ndarray:
        """(queries, k) nodes found, -1 where there are fewer; all queries take a step together."""
        n, q = len(self.vectors), len(queries)
        at = np.full(q, self.levels[-1][0][0])
        for nodes, links in reversed(self.levels[1:]):
            best = self._distance(queries, at[:, None])[:, 0]
            moving = np.ones(q, bool)
            while moving.any():
                rows = np.flatnonzero(moving)
                near = links[np.searchsorted(nodes, at[rows])]
                d = np.where(near >= 0, self._distance(queries[rows], np.maximum(near, 0)), np.inf)
                i = d.argmin(axis=1)
                d = d[np.arange(len(rows)), i]
                nearer = d < best[rows]
                at[rows[nearer]], best[rows[nearer]] = near[nearer, i[nearer]], d[nearer]
                moving[rows[~nearer]] = False
        links = self.levels[0][1]
        beam = max(beam, k)
        seen = np.zeros((q, n), bool)
        found = np.full((q, beam), -1, np.int64)
        length = np.full((q, beam), np.inf, np.float32)
        opened = np.ones((q, beam), bool)
        # Start from the place that the descent found and from the top level's nodes.
        start = np.unique(np.concatenate([self.levels[-1][0][: beam - 1]]))
        first = np.concatenate([np.broadcast_to(start, (q, len(start))), at[:, None]], axis=1)
        d = self._distance(queries, first)
        d[:, -1][(first[:, :-1] == at[:, None]).any(axis=1)] = np.inf
        m = first.shape[1]
        found[:, :m], length[:, :m], opened[:, :m] = first, d, False
        np.put_along_axis(seen, first, True, 1)
        rows = np.arange(q)
        while len(rows):
            d = np.where(opened[rows], np.inf, length[rows])
            i = d.argmin(axis=1)
            alive = np.isfinite(d[np.arange(len(rows)), i])
            rows, i = rows[alive], i[alive]
            if not len(rows):
                break
            opened[rows, i] = True
            near = links[found[rows, i]]
            ok = near >= 0
            near = np.maximum(near, 0)
            ok &= ~seen[rows[:, None], near]
            d = np.where(ok, self._distance(queries[rows], near), np.inf).astype(np.float32)
            seen[rows[:, None], near] |= ok
            all_d = np.concatenate([length[rows], d], axis=1)
            all_n = np.concatenate([found[rows], near], axis=1)
            all_o = np.concatenate([opened[rows], ~ok], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            found[rows], length[rows], opened[rows] = np.take_along_axis(all_n, best, 1), np.take_along_axis(all_d, best, 1), np.take_along_axis(all_o, best, 1)
        order = np.argsort(length, axis=1)[:, :k]
        out = np.take_along_axis(found, order, 1)
        return np.where(np.isfinite(np.take_along_axis(length, order, 1)), out, -1)


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not the zero vector."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def distinct_vectors(df: DataFrame, ids: int, id_col: str, vector_col: str) -> DataFrame:
    """(vector, ids): each different vector with its smallest ``ids`` ids in order.

    A query needs no more of the rows that share a vector, and rows beyond those
    are dropped before the shuffle, so a vector that many rows share is no large group.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.withColumn("__nth", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("__nth") <= ids)
    return rows.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _build_shard(table: pa.Table, config: AnnConfig) -> pa.Table:
    """One row: the shard's vectors, ids and flat neighbour arrays."""
    table = table.sort_by("first")
    dim = table["dim"][0].as_py()
    vectors = np.array(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    graph = Graph.build(vectors.astype(np.float32), config)
    lists = table["ids"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return pa.table(
        {
            "cluster": pa.array([table["cluster"][0].as_py()], pa.int32()),
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "dim": pa.array([dim], pa.int32()),
            "vectors": [vectors.tobytes()],
            "ids": [lists.flatten().to_numpy().astype(np.int64).tobytes()],
            "id_offsets": [np.asarray(lists.offsets).astype(np.int64).tobytes()],
            "level_nodes": [[nodes.tobytes() for nodes, _ in graph.levels]],
            "level_links": [[links.tobytes() for _, links in graph.levels]],
        },
        schema=_INDEX,
    )


_INDEX = pa.schema(
    [("cluster", pa.int32()), ("shard", pa.int32()), ("dim", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("id_offsets", pa.binary()), ("level_nodes", pa.list_(pa.binary())), ("level_links", pa.list_(pa.binary()))]
)
INDEX = "cluster int, shard int, dim int, vectors binary, ids binary, id_offsets binary, level_nodes array<binary>, level_links array<binary>"


@dataclass
class Index:
    """``shards`` has one row for each shard; ``clusters`` has (dim, cluster, shards), at most ``centroids`` rows a length.

    ``routes`` has, by length, the centroids and how many of them a query visits;
    ``sizes``, by length, how many ids each centroid holds.
    """

    shards: DataFrame
    clusters: DataFrame
    routes: dict[int, tuple[np.ndarray, int]]
    sizes: dict[int, np.ndarray]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) squared distances."""
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T))


def fit_route(sample: np.ndarray, clusters: int, config: AnnConfig) -> tuple[np.ndarray, int]:
    """(centroids, centroids to visit) by a few rounds of k-means over the sample."""
    rng = np.random.default_rng(config.seed)
    clusters = min(clusters, len(sample))
    centroids = sample[rng.choice(len(sample), clusters, replace=False)]
    for _ in range(8):
        own = _distances(sample, centroids).argmin(axis=1)
        count = np.bincount(own, minlength=clusters)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    own = _distances(sample, centroids).argmin(axis=1)
    tried = rng.choice(len(sample), min(config.trials, len(sample)), replace=False)
    k = min(config.k, len(sample) - 1)
    if clusters == 1 or k < 1:
        return centroids, clusters
    d = _distances(sample[tried], sample)
    d[np.arange(len(tried)), tried] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(_distances(sample[tried], centroids), axis=1), axis=1)
    visited = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return centroids, int(visited[min(len(visited) - 1, int(np.ceil(config.cover * len(visited))))]) + 1


def visited_centroids(distances: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[list[int]]:
    """By query, its ``visits`` nearest centroids that hold anything, and more in their order until they hold ``least`` ids, or all there are."""
    full = np.flatnonzero(sizes > 0)
    order = full[np.argsort(distances[:, full], axis=1, kind="stable")]
    enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
    return [row[: max(visits, n)].tolist() for row, n in zip(order, enough.tolist(), strict=True)]


def _routed(batches: Iterator[pa.RecordBatch], routes: dict[int, tuple[np.ndarray, int]], sizes: dict[int, np.ndarray] | None, least: int) -> Iterator[pa.RecordBatch]:
    """Batches with ``clusters``: the nearest centroid of each vector, or with ``sizes`` all that a query visits."""
    for batch in batches:
        vectors = batch.column("vector")
        size = vectors.value_lengths().to_numpy()
        out: list[list[int]] = [[0]] * len(size)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            if dim not in routes:
                continue
            centroids, visits = routes[dim]
            own = np.array(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            d = _distances(own, centroids)
            found = d.argmin(axis=1)[:, None].tolist() if sizes is None else visited_centroids(d, visits, sizes[dim], least)
            for row, x in zip(rows.tolist(), found, strict=True):
                out[row] = x
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "clusters"])


def _with_clusters(df: DataFrame, routes: dict[int, tuple[np.ndarray, int]], sizes: dict[int, np.ndarray] | None = None, least: int = 0) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lambda b: _routed(b, routes, sizes, least), f"{schema}, clusters array<int>").withColumn("dim", F.size("vector"))


def build_index(df: DataFrame, config: AnnConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """The index of ``df``: one graph for each shard, as flat arrays. Vectors of different lengths are never in one shard.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do rows without an id; equal vectors are one node. An
    empty table gives an index without shards; other columns are not looked at.
    """
    config = config or AnnConfig()
    nodes = durable(distinct_vectors(df, config.k + 1, id_col, vector_col))
    counts = {r["dim"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("dim")).count().collect()}
    routes: dict[int, tuple[np.ndarray, int]] = {}
    if any(n > config.shard_rows for n in counts.values()):
        sample: dict[int, list] = {}
        for r in nodes.select("vector").orderBy(F.xxhash64(F.lit(config.seed), "vector"), "vector").limit(config.fit_rows).toLocalIterator():
            sample.setdefault(len(r["vector"]), []).append(r["vector"])
        for dim, rows in sample.items():
            clusters = min(config.centroids, -(-counts[dim] // config.shard_rows))
            if clusters > 1:
                routes[dim] = fit_route(np.array(rows, float), clusters, config)
    dealt = durable(_with_clusters(nodes, routes).withColumn("cluster", F.col("clusters")[0]).drop("clusters"))
    clusters = durable(dealt.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / config.shard_rows).cast("int").alias("shards"), F.sum(F.size("ids")).alias("ids")))
    # At most ``centroids`` rows for each length.
    sizes = {dim: np.zeros(len(centroids), np.int64) for dim, (centroids, _) in routes.items()}
    for r in clusters.where(F.col("dim").isin(list(routes))).collect():
        sizes[r["dim"]][r["cluster"]] = r["ids"]
    clusters = clusters.drop("ids")
    dealt = dealt.join(F.broadcast(clusters), ["dim", "cluster"])
    dealt = dealt.select(F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"), "cluster", "dim", "vector", "ids", F.col("ids")[0].alias("first"))
    return Index(dealt.groupBy("cluster", "shard", "dim").applyInArrow(lambda t: _build_shard(t, config), INDEX), clusters, routes, sizes)


def _search_shard(index: pa.Table, queries: pa.Table, config: AnnConfig) -> pa.Table:
    if not index.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    row = index.slice(0, 1).to_pylist()[0]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    ids, at = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_offsets"], np.int64)
    levels = []
    for nodes, links in zip(row["level_nodes"], row["level_links"], strict=True):
        nodes = np.frombuffer(nodes, np.int32)
        levels.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
    graph = Graph(vectors.astype(np.float32), levels)
    asked = queries["vec_id"].to_numpy()
    wanted = np.array(queries["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, row["dim"])
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(asked), 256):
        # One node more, as the query's own may be among them.
        found = graph.search(wanted[a : a + 256].astype(np.float32), config.k + 1, config.beam)
        # A walk that a part of the graph could not leave finds fewer than there are: all of the shard is looked at then.
        short = np.flatnonzero((found >= 0).sum(axis=1) < min(config.k + 1, len(vectors)))
        if len(short):
            near = np.argsort(_distances(wanted[a : a + 256][short], vectors), axis=1, kind="stable")[:, : config.k + 1]
            found[short] = -1
            found[short, : near.shape[1]] = near
        q, j = np.nonzero(found >= 0)
        node = found[q, j]
        gap = vectors[node] - wanted[a : a + 256][q]
        score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        n = at[node + 1] - at[node]
        pick = np.repeat(at[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out_q.append(np.repeat(asked[a : a + 256][q], n)), out_v.append(ids[pick]), out_s.append(np.repeat(score, n))
    q, v, s = (np.concatenate(x) for x in (out_q, out_v, out_s))
    keep = q != v
    q, v, s = q[keep], v[keep], s[keep]
    order = np.lexsort((v, s, q))
    q, v, s = q[order], v[order], s[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < config.k
    return pa.table({"query_id": q[best], "vec_id": v[best], "score": s[best]}, schema=_FOUND)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(index: Index, queries: DataFrame, config: AnnConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found by Euclidean distance, nearest first, ties to the smaller id.

    Queries go to the shards of the centroids they visit, in blocks: a task
    holds one shard and one block of queries, whatever their numbers. However few
    vectors the nearest centroids hold, every query gets ``k`` rows, or all
    candidates if there are fewer. Scores are
    exact distances in double precision. A query never finds its own id. Queries
    that could not be indexed find nothing; ids are whole numbers, and rows that
    repeat an id count once as a query. Without queries, or without an index,
    nothing is found; other columns, of any name, are not looked at.
    """
    config = config or AnnConfig()
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    asked = asked.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"])
    asked = durable(_with_clusters(asked, index.routes, index.sizes, config.k + 1).select("vec_id", "vector", "dim", F.explode("clusters").alias("cluster")))
    parts = asked.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias("parts"))
    # At most ``centroids`` rows for each length.
    visited = durable(index.clusters.join(parts, ["dim", "cluster"]))
    key = ["cluster", "shard", "dim", "part"]
    sent = asked.join(F.broadcast(visited), ["dim", "cluster"])
    sent = sent.select("vec_id", "vector", "dim", "cluster", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    copies = index.shards.join(F.broadcast(visited.select("dim", "cluster", "parts")), ["dim", "cluster"])
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = copies.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(lambda a, b: _search_shard(a, b, config), "query_id long, vec_id long, score double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, queries: DataFrame, config: AnnConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Build the index of ``df`` and search it for ``queries``."""
    return search(build_index(df, config, id_col, vector_col), queries, config, id_col, vector_col)
