"""Vector code compression: a codebook for each part of a vector, fitted by Elkan's form of Lloyd's rounds over whole numbers.

With every part goes an upper bound of the distance to its own entry and a lower
bound for each entry; both are kept in a written table between rounds and are
shifted by the movement of the entries. An entry is left out of a round only if
a bound says that it is strictly farther: its lower bound, or half its distance
from the own entry, lies above the upper bound. What is left is compared by
exact whole numbers, so ties go to the lower index whatever the bounds say.

Lower bounds are stored in one byte, rounded down to a fixed step, upper bounds
in 32 bits, rounded up: both stay true, at a quarter of the room.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsloom.functions.spread import spread_join
from oddsloom.llm import intvec
from oddsloom.session import Scratch


@dataclass(frozen=True)
class CodeConfig:
    """``parts`` equal parts of a vector, ``entries`` a codebook (256 at most: a byte each), ``rounds`` of assignment and
    replacement; components are floor(scale * x). ``chunk`` parts are worked on at a time in a task."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    chunk: int = 1024


@dataclass
class Coded:
    """``rows``: (vec_id, code, error, *keep); ``books``: final entries, (parts, entries, components of a part)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """sha256 of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


@dataclass
class Bounds:
    """What a round needs to know of one part's entries: themselves, their movement since the last round, half their distances
    from each other, and the step of stored lower bounds."""

    entries: np.ndarray
    move: np.ndarray
    half: np.ndarray
    step: float

    @classmethod
    def of(cls, entries: np.ndarray, old: np.ndarray, step: float | None = None) -> Bounds:
        half = np.sqrt(intvec.distances(entries, entries).astype(np.float64)) / 2
        return cls(entries, np.sqrt(intvec.paired(entries, old).astype(np.float64)), half, step or max(1e-9, 2 * half.max(initial=0.0) / 250))


#: Room for rounding in the bounds: they may only prune by more than this.
_SLACK = 1e-6


def _upper(d2: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _lower(d: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.floor((d - _SLACK) / step), 0, 255).astype(np.uint8)


def first_bounds(x: np.ndarray, b: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, upper, lower) of parts that have no entry yet: all are compared."""
    d2 = intvec.distances(x, b.entries)
    own = intvec.first_least(d2)
    return own, _upper(d2[np.arange(len(x)), own]), _lower(np.sqrt(d2.astype(np.float64)), b.step)


def next_bounds(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, b: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(own, upper, lower, compared) after the entries moved; ``compared`` counts the part and entry pairs that no bound pruned."""
    own = own.astype(np.int64)
    up = upper.astype(np.float64) + b.move[own] + _SLACK
    low = lower * b.step - b.move - _SLACK
    half = b.half[own] - _SLACK
    open_ = (low <= up[:, None]) & (half <= up[:, None])
    open_[np.arange(len(x)), own] = False
    rows = np.flatnonzero(open_.any(axis=1))
    compared = 0
    if len(rows):
        # The own distance, exactly, closes most of what is left.
        own_d2 = intvec.paired(x[rows], b.entries[own[rows]])
        up[rows] = tight = np.sqrt(own_d2.astype(np.float64)) + _SLACK
        open_[rows] &= (low[rows] <= tight[:, None]) & (half[rows] <= tight[:, None])
        r, j = np.nonzero(open_[rows])
        compared = len(rows) + len(r)
        if len(r) * 8 > len(rows) * len(b.entries):
            d2 = intvec.distances(x[rows], b.entries)[r, j]
        else:
            d2 = intvec.paired(x[rows][r], b.entries[j])
        low[rows[r], j] = np.sqrt(d2.astype(np.float64))
        low[rows, own[rows]] = np.sqrt(own_d2.astype(np.float64))
        # Least distance of each row, ties to the lower index: the own entry takes part with its exact distance.
        r, j, d2 = np.concatenate([r, np.arange(len(rows))]), np.concatenate([j, own[rows]]), np.concatenate([d2, own_d2])
        order = np.lexsort((j, d2, r))
        first = order[np.searchsorted(r[order], np.arange(len(rows)))]
        own[rows], up[rows] = j[first], np.sqrt(d2[first].astype(np.float64))
    return own, np.nextafter(up.astype(np.float32), np.float32(np.inf)), _lower(low, b.step), compared


def _round(batches: Iterator[pa.RecordBatch], bounds: list[Bounds], config: CodeConfig, first: bool) -> Iterator[pa.RecordBatch]:
    parts, (m, width) = len(bounds), bounds[0].entries.shape
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = intvec.matrix(batch.column("q"), parts * width).reshape(n, parts, width)
        own, upper, lower = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts, m), np.uint8)
        if not first:
            own = intvec.bytes_matrix(batch.column("own"), np.uint8, parts).copy()
            upper = intvec.bytes_matrix(batch.column("upper"), np.float32, parts).copy()
            lower = intvec.bytes_matrix(batch.column("lower"), np.uint8, parts, m).copy()
        for p, b in enumerate(bounds):
            for a in range(0, n, config.chunk):
                at = slice(a, a + config.chunk)
                if first:
                    own[at, p], upper[at, p], lower[at, p] = first_bounds(x[at, p], b)
                else:
                    own[at, p], upper[at, p], lower[at, p], _ = next_bounds(x[at, p], own[at, p], upper[at, p], lower[at, p], b)
        new = {"own": own, "upper": upper, "lower": lower}
        yield pa.RecordBatch.from_arrays([intvec.binary_column(new[c]) if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)


def _sums(batches: Iterator[pa.RecordBatch], parts: int, entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row for each part and entry that has something in this task."""
    n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for batch in batches:
        if batch.num_rows:
            x = intvec.matrix(batch.column("q"), parts * width).reshape(-1, parts, width)
            own = intvec.bytes_matrix(batch.column("own"), np.uint8, parts)
            for p in range(parts):
                np.add.at(s[p], own[:, p], x[:, p])
                n[p] += np.bincount(own[:, p], minlength=entries)
    p, e = np.nonzero(n)
    yield pa.RecordBatch.from_pydict({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(n[p, e]), "s": pa.array(s[p, e].tolist(), pa.list_(pa.int64()))})


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        if not batch.num_rows:
            continue
        x = intvec.matrix(batch.column("q"), parts * width).reshape(-1, parts, width)
        own = intvec.bytes_matrix(batch.column("own"), np.uint8, parts)
        error = sum(intvec.paired(x[:, p], books[p][own[:, p]]) for p in range(parts))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("kept"), pa.array([row.tobytes().hex() for row in own]), pa.array(error)], ["vec_id", "kept", "code", "error"])


def compress(df: DataFrame, config: CodeConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None) -> Coded:
    """Vectors of ``df`` as one byte a part: the index of the nearest entry of the part's codebook, as two hex digits each.

    Codebooks start as the parts of the vectors of smallest id (rows without an
    id last, equal ids by vector) and are fitted to all vectors. Vectors that
    are null or hold a null or non-finite component take no part; nor do those
    of another length than the first one's, or all if that is no multiple of
    ``parts``. Rows that repeat an id or a vector are rows like others; with
    fewer vectors than entries there are fewer entries; an empty table gives no
    rows. Components beyond 2^24 after scaling fail the job. Everything that
    decides is a whole number, so neither partitions nor retries change a code.
    ``keep`` columns come along; others, of any name, are not looked at.
    """
    config, keep = config or CodeConfig(), keep or []
    if not 1 <= config.entries <= 256:
        raise ValueError(f"a byte holds 1 to 256 entries, not {config.entries}")
    kept = F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept")
    rows = df.where(intvec.all_finite(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), kept, intvec.scaled(F.col(vector_col), config.scale).alias("q"))
    start = intvec.smallest(rows.select("vec_id", "q"), config.entries, F.col("vec_id").asc_nulls_last(), F.col("q"))
    dim = len(start[0]["q"]) if start else 0
    if dim % config.parts or not dim:
        rows, start, dim = rows.where("false"), [], config.parts
    elif any(len(r["q"]) != dim for r in start):
        start = intvec.smallest(rows.select("vec_id", "q").where(F.size("q") == dim), config.entries, F.col("vec_id").asc_nulls_last(), F.col("q"))
    width = dim // config.parts
    books = np.array([r["q"] for r in start], np.int64).reshape(-1, config.parts, width).transpose(1, 0, 2)
    m = books.shape[1]
    out = T.StructType([*rows.select("vec_id", "kept").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    scratch = Scratch(df.sparkSession, "codes")
    state = rows.where(F.size("q") == dim).withColumns({c: F.lit(b"").cast("binary") for c in ("own", "upper", "lower")})
    if not m:
        return Coded(_kept(state.mapInArrow(lambda b: iter(()), out), keep), books)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    bounds = [Bounds.of(b, b) for b in books]
    for at in range(config.rounds + 1):
        state = scratch.written(state.mapInArrow(lambda b, k=bounds, f=at == 0: _round(b, k, config, f), schema), str(at))
        if at:
            scratch.drop(str(at - 1))
        if at == config.rounds:
            break
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        partial = state.select("q", "own").mapInArrow(lambda b: _sums(b, config.parts, m, width), "part int, entry int, n long, s array<long>")
        # One row a part and entry.
        for r in intvec.add_up(partial, ["part", "entry"], width).collect():
            counts[r["part"], r["entry"]], sums[r["part"], r["entry"]] = r["n"], r["s"]
        new = np.stack([intvec.floor_means(s, c, b) for s, c, b in zip(sums, counts, books, strict=True)])
        bounds = [Bounds.of(n, o, b.step) for n, o, b in zip(new, books, bounds, strict=True)]
        books = new
    return Coded(_kept(state.select("vec_id", "kept", "q", "own").mapInArrow(lambda b: _coded(b, books), out), keep), books)


def _kept(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select("vec_id", "code", "error", *[F.col("kept")[c].alias(c) for c in keep])


def with_group_error(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``group_error``: the error added up over rows of the same ``group``, nulls together; a group may hold any part of all rows."""
    key: dict[str, Column] = {"__none": F.col(group).isNull(), "__group": F.coalesce(F.col(group).cast("string"), F.lit(""))}
    keyed = rows.withColumns(key)
    sums = keyed.groupBy(*key).agg(F.sum("error").alias("group_error"))
    return spread_join(keyed, sums, list(key), "vec_id").drop(*key)
