"""Codes, products and clusters of vectors against plain loops, with odd rows, ties, copies and empty tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import codes, intvec, lloyd, topk

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [], 1), (9003, [float("nan")] * 8, 1), (9004, [None] + [0.5] * 7, 2), (9005, [float("-inf")] + [1.0] * 7, 2)]


def vectors_of(n, dim=8, seed=0, grid=8.0, spread=1.0):
    """Vectors on a coarse grid, so that distances and products tie; some are copies of the first."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) * spread * grid) / grid
    x[rng.random(n) < 0.25] = x[0]
    return [(int(i), [float(v) for v in row], int(i) % 3 if i % 7 else None) for i, row in enumerate(x)]


def frame(spark, rows):
    """With inner names as columns, and of several partitions."""
    out = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return out.withColumns({c: F.lit("clash") for c in ("q", "own", "upper", "lower", "kept", "cluster", "distance", "previous", "rank", "score", "block", "dim", "code", "error", "__group")})


def whole(rows, scale, dim=None):
    ok = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return [r for r in ok if dim is None or len(r[1]) == dim]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd_by_loops(points, start, rounds):
    """(final centroids, index of each point) of plain Lloyd rounds."""
    centres = [list(c) for c in start]

    def own(p):
        return min(range(len(centres)), key=lambda j: (square(p, centres[j]), j))

    for _ in range(rounds):
        members = {}
        for p in points:
            members.setdefault(own(p), []).append(p)
        centres = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else old for j, old in enumerate(centres)]
    return centres, [own(p) for p in points]


@pytest.mark.parametrize(("n", "entries", "dim"), [(160, 24, 8), (400, 16, 12), (9, 16, 8)])
def test_codes_are_plain_rounds(spark, n, entries, dim):
    rows = vectors_of(n, dim, seed=n) + [(3, [0.25] * dim, 1), (None, [0.5] * dim, 2), (9100, [1.0] * (dim + 4), 1), (9101, [1.0] * 3, 1)] + [r for r in ODD if r[0] != 9003]
    config = codes.CodeConfig(entries=entries, chunk=64)
    coded = codes.compress(frame(spark, rows).drop("label").withColumn("label", F.col("vec_id") % 2), config, keep=["label"])
    good = sorted(whole(rows, 1024, dim), key=lambda r: (r[0] is None, r[0], r[1]))
    width = dim // 4
    want, books = [["", 0] for _ in good], []
    for p in range(4):
        parts = [r[1][p * width : (p + 1) * width] for r in good]
        book, own = lloyd_by_loops(parts, parts[:entries], config.rounds)
        books.append(book)
        for w, part, j in zip(want, parts, own, strict=True):
            w[0] += f"{j:02x}"
            w[1] += square(part, book[j])
    assert coded.books.tolist() == books
    got = sorted(((r.vec_id, r.code, r.error) for r in coded.rows.collect()), key=repr)
    assert got == sorted(((r[0], *w) for r, w in zip(good, want, strict=True)), key=repr)
    assert coded.digest() == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_codes_of_nothing_and_of_parts_that_cannot_be_cut(spark):
    none = codes.compress(frame(spark, []).select("*"), keep=["label"])
    assert none.rows.count() == 0 and none.rows.columns == ["vec_id", "code", "error", "label"]
    assert codes.compress(frame(spark, ODD)).rows.count() == 0
    assert codes.compress(frame(spark, [(1, [1.0] * 6, 1)])).rows.count() == 0
    alike = codes.compress(frame(spark, [(i, [0.5] * 8, 1) for i in range(300)])).rows.collect()
    assert len(alike) == 300 and {(r.code, r.error) for r in alike} == {("00000000", 0)}
    with pytest.raises(ValueError):
        codes.compress(frame(spark, []), codes.CodeConfig(entries=257))
    with pytest.raises(Exception, match="too large"):
        codes.compress(frame(spark, [(1, [1e9] * 8, 1)])).rows.collect()


def test_bounds_prune_and_lose_nothing():
    """Rounds by bounds give what comparing all gives, with ties, copies and entries that jump, and compare less."""
    rng = np.random.default_rng(3)
    compared = total = 0
    for trial in range(30):
        scale, m = int(rng.choice([1, 5, 300])), int(rng.integers(2, 20))
        x = rng.integers(-10, 10, (200, 4)) * scale
        entries = x[:m].copy()
        b = codes.Bounds.of(entries, entries)
        own, upper, lower = codes.first_bounds(x, b)
        for _ in range(6):
            moved = entries + rng.integers(-2, 3, entries.shape) * scale * (rng.random((m, 1)) < 0.5) * (5 if trial % 3 == 0 else 1)
            b = codes.Bounds.of(moved, entries, b.step)
            entries = moved
            own, upper, lower, n = codes.next_bounds(x, own.astype(np.uint8), upper, lower, b)
            compared, total = compared + n, total + x.shape[0] * m
            d = intvec.distances(x, entries)
            assert (own == d.argmin(axis=1)).all()
            assert (upper.astype(float) ** 2 >= d[np.arange(len(x)), own] * (1 - 1e-9)).all()
            assert ((lower * b.step) ** 2 <= d * (1 + 1e-9) + 1e-3).all()
    assert compared < 0.6 * total


def test_group_errors_of_a_hot_group(spark):
    rows = spark.createDataFrame([(i, i % 5, 7 if i % 3 else None) for i in range(2000)], "vec_id long, error long, label int")
    got = {r.label: r.s for r in codes.with_group_error(rows, "label").groupBy("label").agg(F.collect_set("group_error").alias("s")).collect()}
    assert got == {7: [sum(i % 5 for i in range(2000) if i % 3)], None: [sum(i % 5 for i in range(2000) if i % 3 == 0)]}


def products_by_loops(rows, queries, k):
    out = []
    for q, x, _ in queries:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y, _ in rows if i != q and len(x) == len(y))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [30, 16_384])
def test_top_products_are_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = vectors_of(300, seed=1)
    rows += [(1000 + i, [float(np.float32(v)) for v in np.round(rng.normal(size=8) * 2.0 ** rng.integers(-8, 8), 3)], 1) for i in range(200)]
    rows += [(2000 + i, [0.0] * 8, 1) for i in range(8)] + [(2100 + i, [-1.0] * 8, 1) for i in range(6)] + [(2200 + i, [float(i)] * 5, 1) for i in range(4)] + [(1000, [0.5] * 8, 1), (None, [9.0] * 8, 1), *ODD]
    config = topk.TopkConfig(block_rows=block_rows, seeds=40, queries=16)
    df = frame(spark, rows)
    queries = df.where("vec_id % 10 = 0 or vec_id >= 2000")
    good = [r for r in whole(rows, 256) if r[0] is not None]
    asked = {}
    for r in sorted((r for r in good if r[0] % 10 == 0 or r[0] >= 2000), key=lambda r: (r[0], r[1])):
        asked.setdefault(r[0], r)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df, queries, config).collect())
    assert got == products_by_loops(good, list(asked.values()), 5)


def test_top_products_with_few_rows_and_none(spark):
    few = frame(spark, [(0, [1.0, 2.0], 1), (50, [0.5, 0.5], 1), (51, [-1.0, 0.0], 1)])
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_products(few, few.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert topk.top_products(few, few.limit(0)).count() == 0
    assert topk.top_products(few.limit(0), few).count() == 0
    assert topk.top_products(frame(spark, ODD), few).count() == 0


def test_both_prunings_keep_what_is_as_good():
    """Coordinates and lengths leave out only what is strictly worse, and the coordinates leave out much of it."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    x = ((centres[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 24))) * 100).astype(np.int64)
    config = topk.TopkConfig()
    block = topk.Block(np.arange(3000), x, config)
    assert block.switch < 0.95
    looked = 0
    for q in x[:60]:
        norm = np.sqrt(float(q @ q))
        d = block.vectors @ q
        cosine = np.sort(d / np.maximum(block.norm, 1e-9) / norm)[-20]
        rows = block.by_coordinates(q / norm, cosine)
        assert set(np.flatnonzero(d / block.norm / norm >= cosine)) <= set(rows)
        looked += len(rows)
    assert looked < 0.2 * 60 * 3000
    bound = np.array([float(np.sort(x @ q)[-30]) for q in x[:60]])
    query, found, score = block.search(np.arange(60), x[:60], bound)
    want = products_by_loops([(i, v.tolist(), 0) for i, v in enumerate(x)], [(i, x[i].tolist(), 0) for i in range(60)], 5)
    assert sorted(zip(query.tolist(), found.tolist(), score.tolist(), strict=True)) == sorted((q, i, s) for q, _, i, s in want)


def test_short_buckets_are_not_visited(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * (10.0 if i < 40 else 0.01)], 0) for i in range(400)]
    df = frame(spark, rows)
    config = topk.TopkConfig(block_rows=50, seeds=40)
    index = topk.build_index(df, config)
    asked = np.array([intvec_row(r[1]) for r in rows[:20]])
    first, longest = zip(*index.buckets[6], strict=True)
    assert list(longest[:-1]) == sorted(longest[:-1], reverse=True)
    bound = np.sort(index.seeds[6][1] @ asked.T, axis=0)[-6]
    assert (longest[-2] * np.linalg.norm(asked, axis=1) < bound).all() and first[-1] >= 8


def intvec_row(v):
    return [math.floor(256 * np.float32(x)) for x in v]


@pytest.mark.parametrize("n", [300, 12])
def test_clusters_are_plain_rounds(spark, n):
    rows = vectors_of(n, seed=n + 1) + [(2, [0.125] * 8, 1), (None, [0.5] * 8, 1), (9100, [1.0] * 9, 1), *ODD]
    config = lloyd.LloydConfig(clusters=20, dim=8)
    result = lloyd.cluster(frame(spark, rows), config, keep=["label"])
    good = whole(rows, 256, 8)
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres, own = lloyd_by_loops([r[1] for r in good], [r[1] for r in order[:20]], 5)
    assert result.centroids.tolist() == centres
    want = sorted(((r[0], j, square(r[1], centres[j])) for r, j in zip(good, own, strict=True)), key=repr)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in result.rows.collect()), key=repr) == want
    by = {}
    for _, j, d in want:
        by[j] = by.get(j, 0) + d
    for r in lloyd.with_inertia(result).collect():
        assert (r.cluster_inertia, r.inertia) == (by[r.cluster], sum(by.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_clusters_that_settle_end_early_and_empty_tables_have_none(spark):
    rows = [(i, [float(i % 4)] * 8, 1) for i in range(40)]
    result = lloyd.cluster(frame(spark, rows), lloyd.LloydConfig(clusters=4, dim=8, rounds=9))
    assert result.rounds_run < 9
    assert result.rows.where("distance > 0").count() in (0, 10, 20, 30)
    assert lloyd.with_inertia(lloyd.cluster(frame(spark, []), lloyd.LloydConfig(dim=8))).count() == 0
    assert lloyd.with_inertia(lloyd.cluster(frame(spark, ODD), lloyd.LloydConfig(dim=8))).count() == 0


def test_changed_centroids_decide_as_all_of_them():
    rng = np.random.default_rng(6)
    for _ in range(40):
        x = rng.integers(-4, 5, (120, 3))
        centroids = x[rng.choice(120, 12, replace=False)]
        own, distance = lloyd.reassigned(x, np.full(120, -1), np.zeros(120, np.int64), centroids, np.ones(12, bool))
        changed = rng.random(12) < 0.3
        moved = centroids + changed[:, None] * rng.integers(-3, 4, centroids.shape)
        own, distance = lloyd.reassigned(x, own, distance, moved, changed)
        d = intvec.distances(x, moved)
        assert (own == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_distances_are_exact_beyond_doubles():
    a = np.array([[2**24, -(2**24)] * 32, [2**24 - 1, 3] * 32])
    assert intvec.distances(a, a).tolist() == [[square(x, y) for y in a.tolist()] for x in a.tolist()]
