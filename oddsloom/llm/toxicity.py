"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(x.w - threshold_k): one weight vector is shared by all
ordered thresholds. The output is the expected severity, the sum of these
probabilities. Features are the set of a text's hashed words and of the byte
n-grams at the start of its words; sets, not frequencies, as one word in a long
text is enough. Rows are fitted in shards, and the shards' models are averaged.

Labels of 0 and 1 are refined to grades: toxic texts are cut at quantiles of how
often they use telling words, counted with their repetitions. Which words are
telling is learned from the other half of the labelled texts, so that no text
grades itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import text as T
from oddsloom.llm.common import bounded_sample
from oddsloom.llm.quality import scored
from oddsloom.session import durable


@dataclass(frozen=True)
class ToxicityConfig:
    """``fit_rows`` bounds the graded rows that are read; ``rate``, ``l1`` and ``l2`` are FTRL-proximal's, for each shard.
    Features in fewer than ``min_texts`` rows, or as common in toxic rows as in others, are left out.
    A telling word is in ``telling_texts`` toxic texts of the other half or more, and in no clean one."""

    dims: int = 1 << 20
    prefix: int = 5
    grades: int = 3
    fit_rows: int = 12_000
    shards: int = 6
    epochs: int = 6
    rate: float = 0.5
    threshold_rate: float = 0.05
    l1: float = 0.2
    l2: float = 0.1
    min_texts: int = 4
    telling_texts: int = 2
    select_z: float = 4.0
    seed: int = 5


@dataclass
class OrdinalModel:
    """Sparse weights as sorted feature numbers and values, and the ordered thresholds."""

    dims: int
    prefix: int
    feature: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def exceed(self, texts: pa.Array) -> np.ndarray:
        """(texts, thresholds) probabilities of a grade above each threshold."""
        index, at, _ = features(texts, self.dims, self.prefix)
        place, known = positions(self.feature, index)
        total = np.concatenate([[0.0], np.cumsum(np.where(known, np.append(self.weight, 0.0)[place], 0.0))])
        eta = total[at[1:]] - total[at[:-1]]
        return 1.0 / (1.0 + np.exp(-np.clip(eta[:, None] - self.threshold, -60, 60)))


def positions(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each value among the sorted ones."""
    place = np.searchsorted(sorted_values, values)
    return place, np.append(sorted_values, -1)[place] == values


def features(texts: pa.Array, dims: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashed features of each whole text, n + 1 offsets, and how often each occurs."""
    data, at = T.utf8(texts, lower=True)
    words = T.Words(data, at, by_class=True)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    heads = T.byte_grams(padded, prefix)[words.start]
    long = words.end - words.start > prefix
    index = np.concatenate([words.hash, T.mix(heads[long])]) % np.uint64(dims)
    text = np.concatenate([words.text, words.text[long]]).astype(np.int64)
    key, times = np.unique(text * dims + index.astype(np.int64), return_counts=True)
    return key % dims, T.per_text(key // dims, len(at) - 1), times


def _feature_rows(batches: Iterator[pa.RecordBatch], config: ToxicityConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.pieces(batch, "text"):
            index, at, times = features(part.column("text"), config.dims, config.prefix)
            at = pa.array(at.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (index, times)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("key", "half", "label")], *lists], ["key", "half", "label", "features", "times"])


@dataclass
class Chosen:
    """What the counts of features say: the ``selected`` ones, and for each half those that are ``telling`` by the other half's labels."""

    selected: np.ndarray
    telling: tuple[np.ndarray, np.ndarray]


def choose_features(feature: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, config: ToxicityConfig) -> Chosen:
    """From (features, halves) counts of toxic and clean texts; ``feature`` is sorted.

    Selected are features whose rates in toxic and clean texts differ by
    ``select_z`` standard errors or more.
    """
    t, c = toxic.sum(axis=1), clean.sum(axis=1)
    rate = (t + c) / max(1, n_toxic + n_clean)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / max(1, n_toxic) + 1 / max(1, n_clean)))
    keep = (np.abs(t / max(1, n_toxic) - c / max(1, n_clean)) >= config.select_z * error) & (t + c >= config.min_texts)
    telling = (clean == 0) & (toxic >= config.telling_texts)
    return Chosen(feature[keep], (feature[telling[:, 1]], feature[telling[:, 0]]))


def _graded_rows(batches: Iterator[pa.RecordBatch], chosen: Chosen) -> Iterator[pa.RecordBatch]:
    """(key, label, amount, selected): places of the selected features, and how often telling ones occur."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("features")
        index, at, times = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), batch.column("times").flatten().to_numpy()
        half = np.repeat(batch.column("half").to_numpy(), np.diff(at))
        told = np.zeros(len(index), np.int64)
        for h in (0, 1):
            told += np.where((half == h) & positions(chosen.telling[h], index)[1], times, 0)
        amount = np.concatenate([[0], np.cumsum(told)])
        place, known = positions(chosen.selected, index)
        ends = np.concatenate([[0], np.cumsum(known)])[at]
        selected = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[known].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array((amount[at[1:]] - amount[at[:-1]]).astype(float)), selected], ["key", "label", "amount", "selected"])


def fit_ordinal(grade: np.ndarray, index: np.ndarray, at: np.ndarray, size: int, start: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by FTRL-proximal on the shared weights and plain gradient steps on the ordered thresholds."""
    steps = len(start)
    z, n, weight, threshold = np.zeros(size), np.zeros(size), np.zeros(size), start.copy()
    rng = np.random.default_rng(config.seed)
    for epoch in range(config.epochs):
        move = config.threshold_rate / (1 + epoch)
        for r in rng.permutation(len(grade)):
            i = index[at[r] : at[r + 1]]
            p = 1.0 / (1.0 + np.exp(-np.clip(weight[i].sum() - threshold, -35, 35)))
            edge = np.concatenate([[1.0], p, [0.0]])
            k = grade[r]
            # d -log(edge[k] - edge[k + 1]) / d eta; the thresholds on both sides of the grade take their parts.
            slope = edge * (1 - edge) / max(edge[k] - edge[k + 1], 1e-9)
            g = slope[k + 1] - slope[k]
            if abs(g) < 1e-3:
                continue
            old = n[i]
            n[i] = old + g * g
            z[i] += g - (np.sqrt(n[i]) - np.sqrt(old)) / config.rate * weight[i]
            weight[i] = np.where(np.abs(z[i]) <= config.l1, 0.0, -(z[i] - np.sign(z[i]) * config.l1) / ((1.0 + np.sqrt(n[i])) / config.rate + config.l2))
            if k > 0:
                threshold[k - 1] -= move * min(1.0, slope[k])
            if k < steps:
                threshold[k] += move * min(1.0, slope[k + 1])
            threshold = np.maximum.accumulate(threshold)
    return weight, threshold


def _fit_shard(batches: Iterator[pa.RecordBatch], size: int, start: np.ndarray, config: ToxicityConfig) -> Iterator[pa.RecordBatch]:
    """(i, w) sums to be averaged: weights from 0, thresholds from -2 downwards, and the number of rows at -1."""
    lists, grades = [], []
    for batch in batches:
        if batch.num_rows:
            lists.append(batch.column("selected")), grades.append(batch.column("grade").to_numpy())
    if not grades:
        return
    grade, index = np.concatenate(grades).astype(np.int64), np.concatenate([x.flatten().to_numpy() for x in lists])
    at = np.concatenate([[0], np.cumsum(np.concatenate([x.value_lengths().to_numpy() for x in lists]))])
    weight, threshold = fit_ordinal(grade, index, at, size, start, config)
    used = np.flatnonzero(weight)
    i = np.concatenate([used, [-1], -2 - np.arange(len(threshold))])
    w = np.concatenate([weight[used], [1.0], threshold]) * len(grade)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w)], ["i", "w"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> OrdinalModel:
    """The model from labelled rows: 0/1 labels, which are refined, or grades 0, 1, 2, ...

    At most ``fit_rows`` labels are used, those of the smallest key hash, so the
    label side of the join has a proven bound. Features, grades and the fit are
    made on the executors; the driver gets counts by feature, at most ``dims`` of
    them, and the shards' averaged model. Null ids and labels are left out; a
    null text is empty; repeated rows count as often as they occur. Without
    toxic rows, or without clean ones, every score is near 0, or near 1. Other
    columns, of any name, are not looked at.
    """
    config = config or ToxicityConfig()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("known"), F.col(label_col).cast("int").alias("label"))
    known = bounded_sample(known, "known", config.fit_rows, config.seed)
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.pmod(F.xxhash64(F.lit(config.seed), "key"), F.lit(2)).cast("int").alias("half")
    rows = texts.join(F.broadcast(known), F.col("key") == F.col("known")).select("key", half, "label", "text")
    kind = rows.schema["key"].dataType.simpleString()
    found = durable(rows.mapInArrow(lambda b: _feature_rows(b, config), f"key {kind}, half int, label int, features array<int>, times array<int>"))
    shares = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    n, top = sum(shares.values()), max(shares, default=0)
    n_toxic = n - shares.get(0, 0)
    if n_toxic in (0, n):
        return OrdinalModel(config.dims, config.prefix, np.zeros(0, np.int64), np.zeros(0), np.full(max(1, top), 60.0 if not n_toxic else -60.0))

    cells = found.select(F.explode("features").alias("feature"), *[((F.col("half") == h) & ((F.col("label") > 0) == F.lit(toxic))).cast("int").alias(f"c{h}{int(toxic)}") for h in (0, 1) for toxic in (False, True)])
    names = ["c00", "c01", "c10", "c11"]
    table = cells.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names]).where("c00 + c01 + c10 + c11 > 1").orderBy("feature").toArrow()
    counts = {c: table[c].to_numpy() for c in names}
    chosen = choose_features(table["feature"].to_numpy().astype(np.int64), np.stack([counts["c01"], counts["c11"]], 1), np.stack([counts["c00"], counts["c10"]], 1), n_toxic, n - n_toxic, config)
    graded = durable(found.mapInArrow(lambda b: _graded_rows(b, chosen), f"key {kind}, label int, amount double, selected array<int>"))
    if top > 1:
        graded = graded.withColumn("grade", F.col("label"))
    else:
        levels = config.grades - 1
        cuts = graded.where("label > 0").agg(*[F.percentile("amount", F.lit(i / levels)).alias(f"q{i}") for i in range(1, levels)]).first() if levels > 1 else []
        above = [(F.col("amount") > c).cast("int") for c in cuts]
        graded = graded.withColumn("grade", F.when(F.col("label") > 0, sum(above, F.lit(1))).otherwise(0))
        top = levels
    by_grade = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    share = np.clip([sum(m for g, m in by_grade.items() if g > k) / n for k in range(top)], 1e-6, 1 - 1e-6)
    start = np.maximum.accumulate(np.log(1 / share - 1) + 1e-3 * np.arange(top))
    dealt = graded.repartition(config.shards, F.pmod(F.xxhash64("key"), F.lit(config.shards))).sortWithinPartitions("key", "grade", "selected")
    size = len(chosen.selected)
    parts = dealt.select("grade", "selected").mapInArrow(lambda b: _fit_shard(b, size, start, config), "i long, w double")
    out = parts.groupBy("i").agg(F.sum("w").alias("w")).orderBy("i").toArrow()
    i, w = out["i"].to_numpy(), out["w"].to_numpy() / n
    threshold = np.maximum.accumulate(w[i <= -2][::-1])
    return OrdinalModel(config.dims, config.prefix, chosen.selected[i[i >= 0]], w[i >= 0], threshold)


def score_toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = 0.25, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted, grade, expected_severity) for every row, over whole texts.

    ``score`` is P(grade >= 1), ``predicted`` whether that reaches ``threshold``,
    ``grade`` the most probable grade. Null and empty texts have no features and
    get the thresholds alone. Repeated rows are scored alike, an empty table
    gives an empty result, and other columns are not looked at.
    """

    def score(texts: pa.Array) -> dict[str, np.ndarray]:
        p = model.exceed(texts)
        edge = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
        return {
            "score": p[:, 0],
            "predicted": (p[:, 0] >= threshold).astype(np.int32),
            "grade": (-np.diff(edge, axis=1)).argmax(axis=1).astype(np.int32),
            "expected_severity": p.sum(axis=1),
        }

    return scored(docs, score, "score double, predicted int, grade int, expected_severity double", text_col, id_col)
