"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its byte n-grams; the filters are stored
bit-sliced, one bit per language at every slot, so that one lookup (an AND over
the hash positions) returns all languages that contain an n-gram. A text's
hits per language, corrected for each filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import text as T

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdConfig:
    """``fit_rows`` bounds the training rows of each language; an n-gram enters the filter of a language
    in which it is seen in ``min_texts`` texts at least, or in the part ``min_share`` of the language's texts
    if that is fewer, and ``min_ratio`` times as often as in its best language."""

    gram: int = 5
    slots: int = 1 << 20
    hashes: int = 3
    fit_rows: int = 4000
    min_texts: int = 3
    min_share: float = 0.1
    min_ratio: float = 0.2
    seed: int = 11


@dataclass
class BitmaskFilter:
    """``masks[slot, word]`` holds the languages' bits, 64 to a word; ``false_rate`` is per language."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    gram: int
    hashes: int

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """(n-grams, words) masks of the languages that contain each n-gram."""
        found = self.masks[slots(grams, 0, len(self.masks))]
        for i in range(1, self.hashes):
            found = found & self.masks[slots(grams, i, len(self.masks))]
        return found

    def hits(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages) corrected hits: the n-grams from ``at[i]`` to ``at[i + 1]`` belong to text i."""
        found = self.containing(grams)
        out = np.empty((len(at) - 1, len(self.languages)))
        n = np.diff(at)
        for j in range(len(self.languages)):
            bit = (found[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
            total = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            out[:, j] = total[at[1:]] - total[at[:-1]]
        return np.maximum(0.0, (out - n[:, None] * self.false_rate) / (1 - self.false_rate))


def slots(grams: np.ndarray, i: int, n: int) -> np.ndarray:
    """The slot of each n-gram under the i-th hash function."""
    return (T.mix(grams + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(n)).astype(np.int64)


#: ASCII bytes that are no letters become a space, so that n-grams hold letters and word edges.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x80] = 0x20
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


def grams_of(texts: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the lower-cased texts whose second byte belongs to a letter, and n + 1 offsets by text."""
    data, at = T.utf8(texts, lower=True, pad=gram)
    data = np.concatenate([[np.uint8(0x20)], _FOLD[data], np.full(gram, 0x20, np.uint8)])
    grams = T.byte_grams(data, gram)[: at[-1]]
    keep = data[1 : len(grams) + 1] != 0x20
    return grams[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _count(batches: Iterator[pa.RecordBatch], gram: int, languages: list[str]) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(languages)}
    for batch in batches:
        for part in T.pieces(batch, "text"):
            grams, at = grams_of(part.column("text"), gram)
            own: dict[int, list[np.ndarray]] = {}
            for i, lang in enumerate(part.column("lang").to_pylist()):
                own.setdefault(place[lang], []).append(np.unique(grams[at[i] : at[i + 1]]))
            for language, sets in own.items():
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.full(len(found), language, np.int32)), pa.array(n.astype(np.int64))], ["gram", "language", "texts"]
                )


def _slice_bits(batches: Iterator[pa.RecordBatch], config: LangIdConfig, words: int) -> Iterator[pa.RecordBatch]:
    masks = np.zeros((config.slots, words), np.uint64)
    for batch in batches:
        grams = batch.column("gram").to_numpy().view(np.uint64)
        language = batch.column("language").to_numpy()
        for i in range(config.hashes):
            at = slots(grams, i, config.slots)
            for j in np.unique(language):
                masks[at[language == j], j // 64] |= np.uint64(1) << np.uint64(j % 64)
    used = np.flatnonzero(masks.any(axis=1))
    for word in range(words):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), word, np.int32)), pa.array(masks[used, word].view(np.int64))], ["slot", "word", "bits"])


def fit_filters(docs: DataFrame, config: LangIdConfig | None = None, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id") -> BitmaskFilter:
    """Filters learned from ``docs``; rows with a null language, or a text that is null or has no letter, are left out.

    About ``fit_rows`` texts of each language are read at most, those of the
    smallest key hash. N-grams are counted and sliced into bits on the executors; the
    driver gets the finished filter of ``slots`` rows. Without any rows there
    are no languages.
    """
    config = config or LangIdConfig()
    rows = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    counts = rows.groupBy("lang").agg(F.count_if(letters).alias("count")).orderBy("lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return BitmaskFilter([], np.zeros((config.slots, 1), np.uint64), np.zeros(0), config.gram, config.hashes)
    # A key's hash below the share of its language: about fit_rows texts, without sorting or moving any text.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, config.fit_rows / max(1, r["count"]))))])
    unit = F.pmod(F.xxhash64(F.lit(config.seed), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where((unit < F.element_at(share, F.col("lang"))) & letters).select("text", "lang")
    grams = sample.mapInArrow(lambda b: _count(b, config.gram, languages), "gram long, language int, texts long")
    grams = grams.groupBy("gram", "language").agg(F.sum("texts").alias("texts"))
    size = F.array(*[F.lit(float(max(1, min(r["count"], config.fit_rows)))) for r in counts])
    size = F.element_at(size, F.col("language") + 1)
    rate = F.col("texts") / size
    least = F.least(F.lit(float(config.min_texts)), config.min_share * size)
    best = grams.groupBy("gram").agg(F.max(rate).alias("best"))
    chosen = grams.join(best, "gram").where((F.col("texts") >= least) & (rate >= config.min_ratio * F.col("best")))
    words = (len(languages) + 63) // 64
    bits = chosen.select("gram", "language").mapInArrow(lambda b: _slice_bits(b, config, words), "slot long, word int, bits long")
    table = bits.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = np.zeros((config.slots, words), np.uint64)
    masks[table["slot"].to_numpy(), table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    fill = np.array([((masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(languages))])
    return BitmaskFilter(languages, masks, fill**config.hashes, config.gram, config.hashes)


def _scores(texts: pa.Array, model: BitmaskFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, support) of whole texts; the number after the last language is ``und``."""
    n = len(texts)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    grams, at = grams_of(texts, model.gram)
    if not model.languages:
        return np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    hits = model.hits(grams, at)
    best = hits.argmax(axis=1)
    total = hits.sum(axis=1)
    top = np.take_along_axis(hits, best[:, None], 1)[:, 0]
    score = np.where(letters & (total > 0), top / np.where(total > 0, total, 1), 0.0)
    support = np.where(letters, np.minimum(1.0, top / np.maximum(1, np.diff(at))), 0.0)
    return np.where(letters, best, len(model.languages)), score, support


def _predict(batches: Iterator[pa.RecordBatch], model: BitmaskFilter) -> Iterator[pa.RecordBatch]:
    names = pa.array([*model.languages, UNDETERMINED])
    for batch in batches:
        for part in T.pieces(batch, "text"):
            best, score, support = _scores(part.column("text"), model)
            rest = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
            keep = [x for x in part.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*rest, names.take(pa.array(best)), pa.array(score), pa.array(support)], [*keep, "lang_pred", "score", "support"])


def predict_language(docs: DataFrame, model: BitmaskFilter, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, support) for every row of ``docs``, over whole texts.

    ``score`` is the best language's part of all corrected hits, ``support`` its
    corrected hits by n-gram. A null text, or one without a letter, is ``und``
    with score 0; letters unknown to every filter give the first language with
    score 0, as do ties the first in order. Repeated rows are scored alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _predict(b, model), f"doc_id {kind}, lang_pred string, score double, support double")


def keep_recognised(docs: DataFrame, model: BitmaskFilter, least_support: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose language is not ``und`` and has ``least_support`` corrected hits by n-gram or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, text_col):
                best, _, support = _scores(part.column(text_col), model)
                yield part.filter(pa.array((best < len(model.languages)) & (support >= least_support)))

    return docs.mapInArrow(run, docs.schema)
