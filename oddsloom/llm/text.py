"""Whole-batch text primitives over UTF-8 bytes: words, hashes and n-grams without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = 0xD1342543DE82EF95
_ONE = np.uint64(1)
_powers = np.ones(1, np.uint64)

#: Byte classes: 0 white space, 1 letters, digits and every byte beyond ASCII, 2 other signs.
BYTE_CLASS = np.full(256, 2, np.uint8)
BYTE_CLASS[[*b" \t\n\v\f\r"]] = 0
BYTE_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the word base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _WORD_BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most_bytes`` bytes; one text is never cut."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size, dtype=np.int64) // most_bytes
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def utf8(texts: pa.Array, lower: bool = False, pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, each followed by ``pad`` spaces, and where each text begins (n + 1 offsets); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" " * pad, pa.large_string()))
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of many texts.

    ``start`` and ``end`` are byte positions, ``text`` is the number of the text,
    ``hash`` a 64-bit hash of the bytes. With ``by_class``, a word is a run of one
    byte class; otherwise it is a run without white space.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, by_class: bool = False) -> None:
        kind = BYTE_CLASS[data]
        inside = kind > 0
        first = inside.copy()
        if by_class:
            first[1:] &= kind[1:] != kind[:-1]
        else:
            first[1:] &= ~inside[:-1]
        self.start = np.flatnonzero(first)
        n = len(self.start)
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=len(at) - 1)
        if not n:
            self.end, self.hash = self.start, np.zeros(0, np.uint64)
            return
        position = np.arange(len(data))
        within = position - np.maximum.accumulate(np.where(first, position, 0))
        within[~inside] = 0
        terms = (data.astype(np.uint64) + _ONE) * powers(int(within.max()) + 1)[within]
        terms[~inside] = 0
        length = np.add.reduceat(inside.astype(np.int64), self.start)
        self.end = self.start + length
        self.hash = mix(np.add.reduceat(terms, self.start) ^ (length.astype(np.uint64) << np.uint64(48)))


def word_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within a text, in order, and the text of each."""
    total = len(words.hash) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = words.text[:total] == words.text[n - 1 :]
    h = np.zeros(total, np.uint64)
    for i in range(n):
        h = h * np.uint64(_GRAM_BASE) + words.hash[i : i + total]
    return mix(h[whole]), words.text[:total][whole]


def shingles(words: Words, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``n`` words as in :func:`word_grams`; a text of fewer words, but some, has one shingle of all of them."""
    h, text = word_grams(words, n)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        first = np.cumsum(words.count) - words.count
        own = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = words.count[short] > i
            own[has] = own[has] * np.uint64(_GRAM_BASE) + words.hash[first[short[has]] + i]
        own = mix(own ^ (words.count[short].astype(np.uint64) << np.uint64(56)))
        h, text = np.concatenate([h, own]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    return h, text


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Every run of ``n`` <= 8 bytes as one integer, exactly; entry i begins at byte i."""
    total = max(0, len(data) - n + 1)
    grams = np.zeros(total, np.uint64)
    for i in range(n):
        grams = (grams << np.uint64(8)) | data[i : i + total]
    return grams


def per_text(text: np.ndarray, texts: int) -> np.ndarray:
    """n + 1 offsets into values that are sorted by their text's number."""
    return np.searchsorted(text, np.arange(texts + 1))
