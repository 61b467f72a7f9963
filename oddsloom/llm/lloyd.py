"""Centroid clustering by Delta Lloyd: only what moved is compared and added up again.

Assignments and distances are kept in a written table, the sums of all clusters
by the job. A round compares vectors whose own centroid stayed with the changed
centroids alone, as all others were farther before and still are; vectors whose
own centroid moved are compared with all. Vectors that change their cluster are
then taken from one sum and added to the other, as signed whole numbers, so a
round's sums cost what has moved. Without a changed centroid the rest of the
rounds would change nothing, and the job stops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.llm import intvec
from oddsloom.session import Scratch


@dataclass(frozen=True)
class LloydConfig:
    """``clusters`` centroids of ``dim`` components, ``rounds`` of assignment and replacement; components are floor(scale * x)."""

    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    dim: int = 64
    seed: int = 2


@dataclass
class Clustering:
    """``rows``: (vec_id, cluster, distance, *keep); ``centroids``: final components, by number; ``rounds_run`` of assignment."""

    rows: DataFrame
    centroids: np.ndarray
    rounds_run: int

    def digests(self) -> list[str]:
        """sha256 of each centroid's decimal components, joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def reassigned(x: np.ndarray, own: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) against new centroids, given the last ones and which centroids differ from then; -1 has no cluster yet.

    Ties go to the smaller number.
    """
    own, distance = own.copy(), distance.copy()
    moved = (own < 0) | changed[own]
    if moved.any():
        d = intvec.distances(x[moved], centroids)
        own[moved] = best = intvec.first_least(d)
        distance[moved] = d[np.arange(len(d)), best]
    rest, tried = np.flatnonzero(~moved), np.flatnonzero(changed)
    if len(rest) and len(tried):
        d = intvec.distances(x[rest], centroids[tried])
        best = intvec.first_least(d)
        least, number = d[np.arange(len(d)), best], tried[best]
        nearer = (least < distance[rest]) | ((least == distance[rest]) & (number < own[rest]))
        own[rest[nearer]], distance[rest[nearer]] = number[nearer], least[nearer]
    return own, distance


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, changed: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = intvec.matrix(batch.column("q"), centroids.shape[1])
        own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
        cluster, distance = reassigned(x, own, batch.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
        new = {"previous": pa.array(own.astype(np.int32)), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)}
        yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)


def _transfers(batches: Iterator[pa.RecordBatch], clusters: int, dim: int) -> Iterator[pa.RecordBatch]:
    """One row a cluster that gained or lost something in this task: signed counts and sums."""
    n, s = np.zeros(clusters, np.int64), np.zeros((clusters, dim), np.int64)
    for batch in batches:
        new, old = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "previous"))
        x = intvec.matrix(batch.column("q"), dim)
        for at, sign in ((new, 1), (old, -1)):
            known = at >= 0
            np.add.at(s, at[known], sign * x[known])
            n += sign * np.bincount(at[known], minlength=clusters)
    some = np.flatnonzero((n != 0) | (s != 0).any(axis=1))
    yield pa.RecordBatch.from_pydict({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(n[some]), "s": pa.array(s[some].tolist(), pa.list_(pa.int64()))})


def cluster(df: DataFrame, config: LloydConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None) -> Clustering:
    """Vectors of ``df`` in clusters of least squared distance, components taken as floor(scale * x).

    Centroids start as the vectors of the smallest sha256 of ``seed:id``; rows
    without an id come last there, equal hashes are ordered by vector. Vectors
    that are null, of another length or hold a null or non-finite component take
    no part. Rows that repeat an id or a vector are rows like others; with fewer
    vectors than centroids there are fewer centroids, and an empty table gives
    no rows. Components beyond 2^24 after scaling fail the job. Distances and
    sums are whole numbers, so neither partitions nor retries change a result.
    ``keep`` columns come along; others, of any name, are not looked at.
    """
    config, keep = config or LloydConfig(), keep or []
    spark = df.sparkSession
    vector = F.col(vector_col)
    rows = df.where(intvec.all_finite(vector) & (F.size(vector) == config.dim)).select(F.col(id_col).alias("vec_id"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), intvec.scaled(vector, config.scale).alias("q"))
    scratch = Scratch(spark, "lloyd")
    state = scratch.written(rows.withColumns({"cluster": F.lit(-1), "previous": F.lit(-1), "distance": F.lit(0).cast("long")}), "0")
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("vec_id").cast("string")), 256)
    first = intvec.smallest(state.select("q", digest.alias("h")), config.clusters, F.col("h").asc_nulls_last(), F.col("q"))
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, config.dim)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    changed, at = np.ones(len(centroids), bool), 0
    for at in range(config.rounds + 1):
        if not changed.any():
            break
        done = state.mapInArrow(lambda b, c=centroids, m=changed: _assign(b, c, m), schema)
        state = scratch.written(done, str(at + 1))
        scratch.drop(str(at))
        if at == config.rounds:
            break
        moved = state.where("cluster != previous").select("q", "cluster", "previous").mapInArrow(lambda b, k=len(centroids): _transfers(b, k, config.dim), "cluster int, n long, s array<long>")
        # At most one row a centroid.
        for r in intvec.add_up(moved, ["cluster"], config.dim).collect():
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] += np.array(r["s"], np.int64)
        new = intvec.floor_means(sums, counts, centroids)
        changed, centroids = (new != centroids).any(axis=1), new
    return Clustering(state.select("vec_id", "cluster", "distance", *[F.col("kept")[c].alias(c) for c in keep]), centroids, at)


def with_inertia(result: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): distances summed over the cluster and over all."""
    # One row a centroid.
    by = {r["cluster"]: r["s"] for r in result.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    own = F.array(*[F.lit(by.get(i, 0)).cast("long") for i in range(len(result.centroids))], F.lit(0).cast("long"))
    digest = F.array(*[F.lit(d) for d in result.digests()], F.lit(""))
    return result.rows.select("vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(by.values())).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
