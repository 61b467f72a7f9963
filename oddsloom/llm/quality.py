"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text is a sparse vector of hashed words and word pairs; a score is a sparse
dot product. Training runs over a bounded sample of labelled rows in shards,
each with its own FTRL-proximal pass, whose weights are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import text as T
from oddsloom.llm.common import bounded_sample


@dataclass(frozen=True)
class QualityConfig:
    """``fit_rows`` bounds the labelled rows that are read; the rest are FTRL-proximal's parameters."""

    dims: int = 1 << 18
    fit_rows: int = 12_000
    shards: int = 6
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.001
    seed: int = 3


def features(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word pairs of whole texts as rows: (index, value, offsets).

    Words are runs of one byte class, so that signs count as words; a pair of
    equal words is one feature of its own, whatever the word. Values are square
    roots of counts, scaled to length 1 by text.
    """
    data, at = T.utf8(texts)
    words = T.Words(data, at, by_class=True)
    n = len(at) - 1
    pairs, pair_text = T.word_grams(words, 2)
    if len(words.hash) > 1:
        same = words.text[:-1] == words.text[1:]
        pairs = np.where((words.hash[:-1] == words.hash[1:])[same], np.uint64(0x5EED), pairs)
    index = np.concatenate([words.hash, pairs]) % np.uint64(dims)
    key = np.concatenate([words.text, pair_text]).astype(np.int64) * dims + index.astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    text = key // dims
    value = np.sqrt(count)
    length = np.sqrt(np.bincount(text, weights=value**2, minlength=n))
    return key % dims, value / length[text], T.per_text(text, n)


def ftrl(index: np.ndarray, value: np.ndarray, at: np.ndarray, label: np.ndarray, config: QualityConfig) -> np.ndarray:
    """Weights (the bias last) after FTRL-proximal updates over the rows in a fixed shuffled order."""
    z, n = np.zeros(config.dims + 1), np.zeros(config.dims + 1)
    rng = np.random.default_rng(config.seed)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * config.l1) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2)
        return np.where(np.abs(zi) <= config.l1, 0.0, w)

    for _ in range(config.epochs):
        for row in rng.permutation(len(label)):
            i = np.append(index[at[row] : at[row + 1]], config.dims)
            x = np.append(value[at[row] : at[row + 1]], 1.0)
            w = weight(z[i], n[i])
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label[row]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / config.alpha * w
            n[i] += g * g
    return weight(z, n)


def _fit_shard(batches: Iterator[pa.RecordBatch], config: QualityConfig) -> Iterator[pa.RecordBatch]:
    found, labels = [], []
    for batch in batches:
        for part in T.pieces(batch, "text"):
            found.append(features(part.column("text"), config.dims))
            labels.append(part.column("label").to_numpy())
    if not found:
        return
    sizes = np.concatenate([np.diff(at) for _, _, at in found])
    label = np.concatenate(labels).astype(float)
    w = ftrl(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([[0], np.cumsum(sizes)]), label, config)
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(w[used] * len(label), float(len(label))))], ["i", "w"])


def fit_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig | None = None, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> np.ndarray:
    """Weights learned from the rows of ``docs`` that ``labels`` marks 0 or 1.

    At most ``fit_rows`` labels are used, those of the smallest key hash, so the
    label side of the join has a proven bound and no text moves to be joined.
    The driver gets ``dims`` + 1 averaged weights. Null ids and labels are left
    out; a null text is empty; repeated rows count as often as they occur. Without
    labelled rows all weights are 0 and every score is one half. Other columns,
    of any name, are not looked at.
    """
    config = config or QualityConfig()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("known"), F.col(label_col).cast("int").alias("label"))
    known = bounded_sample(known, "known", config.fit_rows, config.seed)
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), F.col("key") == F.col("known"))
    dealt = rows.repartition(config.shards, F.pmod(F.xxhash64("key"), F.lit(config.shards))).sortWithinPartitions("key", "label", "text")
    parts = dealt.select("text", "label").mapInArrow(lambda b: _fit_shard(b, config), "i long, w double")
    table = parts.groupBy("i").agg(F.sum("w").alias("w")).toArrow()
    i, w = table["i"].to_numpy(), table["w"].to_numpy()
    out = np.zeros(config.dims + 1)
    if len(i):
        out[i[i >= 0]] = w[i >= 0] / w[i < 0].sum()
    return out


def score_rows(weights: np.ndarray, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sparse dot products with the bias, as probabilities."""
    total = np.concatenate([[0.0], np.cumsum(weights[index] * value)])
    return 1.0 / (1.0 + np.exp(-(total[at[1:]] - total[at[:-1]] + weights[-1])))


def scored(docs: DataFrame, score: Callable[[pa.Array], dict[str, np.ndarray]], columns: str, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, ``columns``) from a function of a batch of whole texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text"):
                found = score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x) for x in found.values()]], ["doc_id", *found])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) for every row, over whole texts of any length.

    Null and empty texts get the bias alone. Repeated rows are scored alike, an
    empty table gives an empty result, and other columns are not looked at.
    """
    dims = len(weights) - 1

    def score(texts: pa.Array) -> dict[str, np.ndarray]:
        s = score_rows(weights, *features(texts, dims))
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return scored(docs, score, "score double, predicted int", text_col, id_col)
