"""Small fitted models: ordinal, multinomial and binary logits, choices among candidates, and temperature.

Each evaluation of a loss and its gradient is one Spark job that adds up
partial sums by task, so a design of any length can be fitted; the driver holds
the coefficients and their curvature alone and does the line search. Designs are standardised by
population deviations, coefficients are penalised, cutpoints and intercepts are not.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Generator, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import draws
from oddsloom.functions.guards import IntegrityError, positive_int, within
from oddsloom.session import stored

CLIP = 1e-12
ARMIJO, HALVINGS = 1e-4, 50


@dataclass(frozen=True)
class FitConfig:
    """Penalty, most iterations, and the gradient's length at which a fit has converged."""

    l2: float = 1.0
    max_iter: int = 2000
    grad_tol: float = 1e-6


@dataclass
class LogitModel:
    """Coefficients over standardised features; ``cuts`` are cutpoints or intercepts, by ``kind``."""

    kind: str
    features: list[str]
    mean: list[float]
    std: list[float]
    coef: list
    cuts: list[float]
    n: int
    loss: float
    iterations: int
    converged: bool = True
    l2: float = 1.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=2)

    @classmethod
    def from_json(cls, text: str) -> LogitModel:
        model = cls(**json.loads(text))
        if not len(model.features) == len(model.mean) == len(model.std):
            raise ValueError("a model's features, means and deviations differ in number")
        return model

    def report(self) -> list[tuple[str, float]]:
        """Features by absolute coefficient, largest first."""
        pairs = zip(self.features, self.coef if self.kind != "multinomial" else np.abs(self.coef).max(axis=0).tolist(), strict=True)
        return sorted(((f, float(c)) for f, c in pairs), key=lambda x: -abs(x[1]))


Search = Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float, int, bool]]


def search(start: np.ndarray, c: FitConfig) -> Search:
    """Asks for losses and gradients of points, and returns (best point, its loss, iterations, converged).

    Quasi-Newton steps with an Armijo line search: an evaluation is a pass over
    all rows, so curvature is gathered from the gradients (the inverse Hessian
    as a small matrix), which takes far fewer of them than steps along the
    gradient. A point has converged if its gradient is short, or nearly so where
    no step lowers the loss any more, in double precision.
    """
    x = start.astype(float)
    f, g = yield x
    inverse, fresh = np.eye(len(x)), True
    for i in range(positive_int(c.max_iter, "max_iter")):
        if np.sqrt(float(g @ g)) < c.grad_tol:
            return x, f, i, True
        move = -inverse @ g
        slope = float(g @ move)
        if slope >= 0:
            inverse, fresh = np.eye(len(x)), True
            move, slope = -g, -float(g @ g)
        step = 1.0
        for _ in range(HALVINGS):
            new = x + step * move
            f_new, g_new = yield new
            if f_new <= f + ARMIJO * step * slope:
                break
            step /= 2
        else:
            if fresh:
                return x, f, i, bool(np.sqrt(float(g @ g)) < np.sqrt(c.grad_tol))
            inverse, fresh = np.eye(len(x)), True
            continue
        s, y = new - x, g_new - g
        curvature = float(s @ y)
        if curvature > 1e-12 * float(y @ y):
            if fresh:
                inverse = np.eye(len(x)) * (curvature / float(y @ y))
            r = np.eye(len(x)) - np.outer(s, y) / curvature
            inverse, fresh = r @ inverse @ r.T + np.outer(s, s) / curvature, False
        x, f, g = new, f_new, g_new
    return x, f, c.max_iter, bool(np.sqrt(float(g @ g)) < c.grad_tol)


def descend_together(evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], starts: dict[int, np.ndarray], c: FitConfig) -> dict[int, tuple[np.ndarray, float, int, bool]]:
    """The results of a search from each start; all that still run are evaluated in the same pass."""
    running = {k: search(x, c) for k, x in starts.items()}
    asked, done = {k: next(s) for k, s in running.items()}, {}
    while asked:
        answers, now = evaluate(asked), {}
        for k, answer in answers.items():
            try:
                now[k] = running[k].send(answer)
            except StopIteration as end:
                done[k] = end.value
        asked = now
    return done


def descend(loss_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, c: FitConfig) -> tuple[np.ndarray, float, int, bool]:
    """One search."""
    return descend_together(lambda points: {k: loss_and_gradient(x) for k, x in points.items()}, {0: start}, c)[0]


def standardizer(rows: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations; a deviation of 0 becomes 1."""
    r = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    return [float(r[f"m{i}"]) for i in range(len(features))], [float(r[f"s{i}"]) or 1.0 for i in range(len(features))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _part_ordinal(x: np.ndarray, y: np.ndarray, p: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray]:
    d = x.shape[1]
    a = p[d:]
    soft = np.log1p(np.exp(-np.abs(a[1:]))) + np.maximum(a[1:], 0)
    cut = a[0] + np.concatenate([[0.0], np.cumsum(soft)])
    c = _sigmoid(cut + (x @ p[:d])[:, None])
    edge = np.concatenate([np.zeros((len(x), 1)), c, np.ones((len(x), 1))], axis=1)
    cell = np.maximum(edge[np.arange(len(x)), y + 1] - edge[np.arange(len(x)), y], CLIP)
    slope = edge * (1 - edge)
    up, down = times * slope[np.arange(len(x)), y + 1] / cell, times * slope[np.arange(len(x)), y] / cell
    by_cut = np.zeros(len(cut) + 2)
    np.add.at(by_cut, y + 1, -up)
    np.add.at(by_cut, y, down)
    g_cut = by_cut[1:-1]
    tail = np.cumsum(g_cut[::-1])[::-1]
    return -times @ np.log(cell), np.concatenate([x.T @ (down - up), [tail[0]], tail[1:] * _sigmoid(a[1:])])


def _part_multinomial(x: np.ndarray, y: np.ndarray, p: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray]:
    k = len(p) // (x.shape[1] + 1)
    w, b = p[: k * x.shape[1]].reshape(k, -1), p[k * x.shape[1] :]
    eta = np.concatenate([np.zeros((len(x), 1)), x @ w.T + b], axis=1)
    eta -= eta.max(axis=1, keepdims=True)
    q = np.exp(eta)
    q /= q.sum(axis=1, keepdims=True)
    loss = -times @ np.log(np.maximum(q[np.arange(len(x)), y], CLIP))
    q[np.arange(len(x)), y] -= 1
    q *= times[:, None]
    return loss, np.concatenate([(q[:, 1:].T @ x).ravel(), q[:, 1:].sum(axis=0)])


def _part_binary(x: np.ndarray, y: np.ndarray, p: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray]:
    z = x @ p[:-1] + p[-1]
    loss = times @ (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))
    e = times * (_sigmoid(z) - y)
    return loss, np.append(x.T @ e, e.sum())


_PARTS = {"ordinal": _part_ordinal, "multinomial": _part_multinomial, "binary": _part_binary}


def added(parts: DataFrame) -> np.ndarray:
    """The sum of one short vector for each task."""
    return np.sum([r["sums"] for r in parts.collect()], axis=0)


def _pass_over(design: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int, d: int) -> np.ndarray:
    """The sum of ``part(x, y, key)`` over slices of a design (x, y, k): one vector leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                total += part(piece.column("x").flatten().to_numpy().reshape(-1, d), piece.column("y").to_numpy(), piece.column("k").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

    return added(design.mapInArrow(run, "sums array<double>"))


def fit(rows: DataFrame, features: list[str], label: str, kind: str, config: FitConfig = FitConfig()) -> LogitModel:
    """Fit on ``rows`` with whole-number labels from 0; null features or labels fail, as does a single class.

    The check, the moments and each evaluation of the fit are passes over all rows.
    """
    return _fit_all(rows, features, label, kind, config, None)[0]


def fit_replicates(rows: DataFrame, features: list[str], label: str, kind: str, replicates: int, seed: int, key: str = "match_id", config: FitConfig = FitConfig()) -> list[LogitModel]:
    """One model for each bootstrap replicate, all fitted in the same passes.

    A replicate draws each match a Poisson number of times, from key, replicate
    and seed; all rows of a match count as often. That is a fit over the rows
    repeated so often, with its own means and deviations.
    """
    positive_int(replicates, "replicates")
    number = draws.key_number(F.col(key), rows.schema[key].dataType.simpleString())
    return _fit_all(rows, features, label, kind, config, Weighting(replicates, number, lambda k: draws.poisson_times(draws.units(k, replicates, seed))))


def fit_folds(rows: DataFrame, features: list[str], label: str, kind: str, block: Column, folds: int, config: FitConfig = FitConfig()) -> list[LogitModel]:
    """One model for each fold, all fitted in the same passes: fold f is fitted on the rows of blocks 0..f.

    Rows of later blocks, or without one, count for nothing in a fold: neither
    in its means and deviations nor in its loss.
    """
    positive_int(folds, "folds")
    return _fit_all(rows, features, label, kind, config, Weighting(folds, F.coalesce(block, F.lit(folds)).cast("bigint"), lambda k: k[:, None] <= np.arange(folds)))


def out_of_fold(rows: DataFrame, models: list[LogitModel], block: Column) -> DataFrame:
    """``rows`` of blocks from 1 on with ``eta`` and ``cuts`` of the ordinal model that saw earlier blocks alone; block f + 1 has the model of fold f.

    All models are columns over the same row, so nothing is shuffled.
    """
    etas = F.array(*[linear(m, m.coef) for m in models])
    cuts = F.array(*[F.array(*[F.lit(float(c)) for c in m.cuts]) for m in models])
    inside = (block >= 1) & (block <= len(models))
    return rows.where(inside).withColumns({"eta": F.element_at(etas, block), "cuts": F.element_at(cuts, block)})


@dataclass(frozen=True)
class Weighting:
    """How often a row counts in each of ``models`` fits: a whole number by row, and what it means, as (rows, models)."""

    models: int
    number: Column
    times: Callable[[np.ndarray], np.ndarray]


def _fit_all(rows: DataFrame, features: list[str], label: str, kind: str, config: FitConfig, weighting: Weighting | None) -> list[LogitModel]:
    bad = F.lit(False)
    for c in (*features, label):
        bad = bad | F.col(c).isNull()
    if not rows.where(bad).isEmpty():
        raise IntegrityError("the design has nulls")
    mean, std = standardizer(rows, features)
    n_models = weighting.models if weighting else 1
    number = weighting.number if weighting else F.lit(0).cast("bigint")
    times = weighting.times if weighting else None
    x = F.array(*[((F.col(f) - m) / s).cast("double") for f, m, s in zip(features, mean, std, strict=True)])
    design = stored(rows.select(x.alias("x"), F.col(label).cast("int").alias("y"), number.alias("k")))
    classes = (design.agg(F.max("y")).first()[0] or 0) + 1
    d = len(features)

    def times_of(k: np.ndarray) -> np.ndarray:
        return np.ones((len(k), 1)) if times is None else times(k).astype(float)

    def moments(xs: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        t = times_of(k)
        return np.concatenate([t.T @ np.eye(classes)[y], t.T @ xs, t.T @ xs**2], axis=1).reshape(-1)

    sums = _pass_over(design, moments, n_models * (classes + 2 * d), d).reshape(n_models, -1)
    counts, first, second = np.split(sums, [classes, classes + d], axis=1)
    if ((counts > 0).sum(axis=1) < 2).any():
        raise IntegrityError("the labels hold fewer than two classes")
    n = counts.sum(axis=1)
    # Moments of the standardised design: 0 and 1 but for weighted rows and for features that never vary.
    shift = first / n[:, None] if weighting else np.zeros((1, d))
    scale = np.sqrt(np.maximum(second / n[:, None] - shift**2, 0)) if weighting else np.ones((1, d))
    scale[scale < 1e-12] = 1.0
    starts = {r: _start(kind, counts[r], n[r], d) for r in range(n_models)}
    penalised = len(starts[0]) - (classes - 1) if kind != "binary" else d
    part, size = _PARTS[kind], len(starts[0])

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def add(xs: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
            t, out = times_of(k), []
            for r, p in points.items():
                loss, g = part((xs - shift[r]) / scale[r], y, p, t[:, r])
                out.append(np.append(g, loss))
            return np.concatenate(out)

        sums = _pass_over(design, add, len(points) * (size + 1), d).reshape(len(points), -1)
        answers = {}
        for (r, p), total in zip(points.items(), sums, strict=True):
            g = total[:-1] / n[r]
            g[:penalised] += config.l2 * p[:penalised]
            answers[r] = total[-1] / n[r] + config.l2 / 2 * float(p[:penalised] @ p[:penalised]), g
        return answers

    found = descend_together(evaluate, starts, config)
    models = []
    for r in range(n_models):
        best, loss, iterations, converged = found[r]
        if kind == "ordinal":
            a = best[d:]
            coef, cuts = best[:d].tolist(), (a[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, a[1:]))])).tolist()
        elif kind == "multinomial":
            coef, cuts = best[:penalised].reshape(classes - 1, d).tolist(), best[penalised:].tolist()
        else:
            coef, cuts = best[:d].tolist(), [float(best[d])]
        own_mean = [m + s * v for m, s, v in zip(mean, std, shift[r].tolist(), strict=True)]
        own_std = [s * v for s, v in zip(std, scale[r].tolist(), strict=True)]
        models.append(LogitModel(kind, features, own_mean, own_std, coef, cuts, int(n[r]), float(loss), iterations, converged, config.l2))
    return models


def _start(kind: str, counts: np.ndarray, n: float, d: int) -> np.ndarray:
    """Coefficients of 0, and the cutpoints or intercepts that give the classes' shares."""
    classes = len(counts)
    if kind == "ordinal":
        share = np.clip(np.cumsum(counts)[:-1] / n, 1e-6, 1 - 1e-6)
        cut = np.maximum.accumulate(np.log(share / (1 - share)))
        gaps = np.maximum(np.diff(cut), 1e-6)
        return np.concatenate([np.zeros(d), cut[:1], np.log(np.expm1(gaps))])
    counts = np.maximum(counts, 1)
    if kind == "multinomial":
        return np.concatenate([np.zeros((classes - 1) * d), np.log(counts[1:] / counts[0])])
    return np.append(np.zeros(d), np.log(counts[1] / counts[0]))


def vectors(model: LogitModel, xs: np.ndarray) -> np.ndarray:
    """(rows, classes) of a model over raw features, as :func:`probabilities` gives them."""
    z = (xs - np.array(model.mean)) / np.array(model.std)
    if model.kind == "ordinal":
        edges = np.concatenate([np.zeros((len(z), 1)), _sigmoid(np.array(model.cuts) + (z @ np.array(model.coef))[:, None]), np.ones((len(z), 1))], axis=1)
        return np.clip(np.diff(edges, axis=1), CLIP, 1 - CLIP)
    if model.kind == "multinomial":
        eta = np.concatenate([np.zeros((len(z), 1)), z @ np.array(model.coef).T + np.array(model.cuts)], axis=1)
        power = np.exp(eta - eta.max(axis=1, keepdims=True))
        return np.clip(power / power.sum(axis=1, keepdims=True), CLIP, 1 - CLIP)
    first = _sigmoid(z @ np.array(model.coef) + model.cuts[0])
    return np.stack([first, 1 - first], axis=1)


def replicate_bands(rows: DataFrame, key: list[str], models: list[LogitModel], level: float = 0.9) -> DataFrame:
    """(key, low, high, sides): the band of each class's chance over the replicates' models, percentiles with linear interpolation,
    and the first side's chance (the first half of the classes) by every model."""
    within(level, 0, 1, "level")
    names, d = models[0].features, len(models[0].features)
    picked = rows.select(*key, F.array(*[F.col(f).cast("double") for f in names]).alias("__x"))
    edges = [50 * (1 - level), 50 * (1 + level)]
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                xs = piece.column("__x").flatten().to_numpy().reshape(-1, d)
                p = np.stack([vectors(m, xs) for m in models])
                low, high = np.percentile(p, edges, axis=0)
                sides = p[:, :, : p.shape[2] // 2].sum(axis=2).T
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in key], *[pa.array(x.tolist(), kind) for x in (low, high, sides)]], [*key, "low", "high", "sides"])

    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in key], "low array<double>", "high array<double>", "sides array<double>"]))


def linear(model: LogitModel, coef: list[float]) -> Column:
    """The linear predictor as a column over the raw features."""
    terms = [(F.col(f) - m) / s * c for f, m, s, c in zip(model.features, model.mean, model.std, coef, strict=True)]
    return sum(terms[1:], terms[0])


def _logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _clip(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1.0 - CLIP), p))


def ordinal_cells(eta: Column, cuts: list[float], temperature: float = 1.0) -> Column:
    """Cells between logistic cutpoints at eta / temperature, clipped and not renormalised."""
    c = [_logistic(F.lit(float(t)) + eta / float(temperature)) for t in cuts]
    edges = [F.lit(0.0), *c, F.lit(1.0)]
    return F.array(*[_clip(b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def probabilities(model: LogitModel, temperature: float = 1.0) -> Column:
    """ARRAY<DOUBLE> of a model as a column, all in the JVM; the binary one is (first side, second side)."""
    if model.kind == "ordinal":
        return ordinal_cells(linear(model, model.coef), model.cuts, temperature)
    if model.kind == "multinomial":
        power = [F.lit(1.0), *[F.exp(linear(model, w) + F.lit(b)) for w, b in zip(model.coef, model.cuts, strict=True)]]
        total = sum(power[1:], power[0])
        return F.array(*[_clip(x / total) for x in power])
    first = _logistic(linear(model, model.coef) + F.lit(model.cuts[0]))
    return F.array(first, F.lit(1.0) - first)


def fit_choice(candidates: DataFrame, features: list[str], step: list[str], chosen: str, config: FitConfig = FitConfig()) -> LogitModel:
    """Conditional logit among the candidates of each step: one row each, ``chosen`` true for one of them."""
    wrong = candidates.groupBy(*step).agg(F.sum(F.col(chosen).cast("int")).alias("n")).where("n <> 1")
    if not wrong.isEmpty():
        raise IntegrityError("a step without exactly one choice")
    mean, std = standardizer(candidates, features)
    x = F.array(*[((F.col(f) - m) / s).cast("double") for f, m, s in zip(features, mean, std, strict=True)])
    # A step has as many rows as there are candidates, a handful; steps are spread over tasks.
    design = stored(candidates.select(*step, F.struct((~F.col(chosen)).alias("no"), x.alias("x")).alias("c")).groupBy(*step).agg(F.array_sort(F.collect_list("c")).alias("c")).select(F.transform("c", lambda c: c["x"]).alias("x")))
    n, d = design.count(), len(features)

    def evaluate(p: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    steps = batch.column("x").slice(at, 4096)
                    # All candidates of the slice's steps under one another; a step's first is what was chosen.
                    sizes = np.diff(steps.offsets.to_numpy())
                    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    xs = steps.flatten().flatten().to_numpy().reshape(-1, d)
                    s = xs @ p
                    q = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
                    q /= np.repeat(np.add.reduceat(q, first), sizes)
                    total[:d] += xs.T @ q - xs[first].sum(axis=0)
                    total[d] -= np.log(np.maximum(q[first], CLIP)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

        sums = added(design.mapInArrow(run, "sums array<double>"))
        return sums[-1] / n + config.l2 / 2 * float(p @ p), sums[:-1] / n + config.l2 * p

    best, loss, iterations, converged = descend(evaluate, np.zeros(d), config)
    return LogitModel("choice", features, mean, std, best.tolist(), [], n, loss, iterations, converged, config.l2)


#: Fixed values of the search for a temperature: bounds, values of the coarse and of the fine grid, and how far the fine one reaches.
T_LOW, T_HIGH, T_COARSE, T_FINE, T_REACH = 0.05, 20.0, 97, 61, 1.5


def fit_temperature(rows: DataFrame, eta: str, cuts: str, label: str) -> tuple[float, float, float, int]:
    """(temperature, loss at it, loss at 1, rows) of least negative log likelihood over two geometric grids.

    ``cuts`` is an array: rows may have cutpoints of different models. The
    coarse grid has 1 in it, so the loss found is never above that at 1; the
    fine one lies around the best of the coarse one. A grid is one pass over all
    rows: a task adds up the losses of all its values. No rows, a null or a label
    without a cell fails.
    """
    bound = rows.select(F.col(eta).cast("double").alias("eta"), F.col(cuts).cast("array<double>").alias("cuts"), F.col(label).cast("int").alias("y"))
    inside = (F.col("y") >= 0) & (F.col("y") <= F.size("cuts")) & F.col("eta").isNotNull()
    bound = bound.withColumn("y", F.when(F.coalesce(inside, F.lit(False)), F.col("y")).otherwise(F.raise_error(F.lit("a row without a predictor or with a label beyond its cutpoints")).cast("int")))

    def losses(grid: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(grid) + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    piece = batch.slice(at, 4096)
                    e, y = piece.column("eta").to_numpy(), piece.column("y").to_numpy()
                    c = piece.column("cuts").flatten().to_numpy().reshape(len(e), -1)
                    row = np.arange(len(e))
                    # The two edges of the row's own cell alone.
                    low = np.where(y > 0, c[row, np.maximum(y - 1, 0)], -np.inf)
                    high = np.where(y < c.shape[1], c[row, np.minimum(y, c.shape[1] - 1)], np.inf)
                    total[-1] += len(e)
                    for j, t in enumerate(grid):
                        total[j] -= np.log(np.clip(_sigmoid(high + e / t) - _sigmoid(low + e / t), CLIP, 1 - CLIP)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

        return added(bound.mapInArrow(run, "sums array<double>"))

    coarse = np.append(np.geomspace(T_LOW, T_HIGH, T_COARSE), 1.0)
    *first, n = losses(coarse)
    if not n:
        raise IntegrityError("no rows to fit a temperature on")
    at = int(np.argmin(first))
    fine = np.clip(np.geomspace(coarse[at] / T_REACH, coarse[at] * T_REACH, T_FINE), T_LOW, T_HIGH)
    second = losses(fine)[:-1]
    best = int(np.argmin(second))
    t, loss = (fine[best], second[best]) if second[best] < first[at] else (coarse[at], first[at])
    return float(t), float(loss), float(first[-1]), int(n)


def four_way_baseline(rate_a: Column, rate_b: Column, overtime: Column) -> Column:
    """Four cells from two win rates and an overtime rate."""
    p = F.coalesce(F.try_divide(rate_a, rate_a + rate_b), F.lit(0.5))
    q = F.lit(1.0) - p
    return F.array(p * (1 - overtime), p * overtime, q * overtime, q * (1 - overtime))


def information_criteria(model: LogitModel) -> dict[str, float]:
    """AIC and BIC from the unpenalised part of the model's loss."""
    penalty = model.l2 / 2 * float(np.sum(np.square(model.coef)))
    ll = -(model.loss - penalty) * model.n
    k = int(np.size(model.coef) + len(model.cuts))
    return {"log_likelihood": ll, "aic": -2 * ll + 2 * k, "bic": -2 * ll + k * float(np.log(model.n))}
