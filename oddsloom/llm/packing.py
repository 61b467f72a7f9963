"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing runs over counts of equal lengths, not over documents, so
its cost does not grow with the corpus. The plan says, for each length, which
ranks go to which sequences at which offset; documents take their slots by
joining on their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql import Window as W

from oddsloom.llm import text as T
from oddsloom.session import durable


@dataclass(frozen=True)
class PackConfig:
    """The vocabulary's files on every executor, the sequence length in tokens and the id that ends a document."""

    tokenizer: str
    ranks: str
    length: int = 2048
    end_id: int = 0
    #: About how many pieces of one length share a rank block; a block is one task's sort group at most.
    block_rows: int = 50_000


class DocumentTokenizer:
    """Ids of whole texts under a byte-level vocabulary that is given in two forms.

    Both forms hold the same merges; the ranks are encoded about four times as
    fast. A text with a special token's string goes to the full tokenizer,
    which turns that string into its one id.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self._file, self._full = tokenizer, None
        with open(tokenizer, encoding="utf-8") as f:
            self._specials = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        if any(s in text for s in self._specials):
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._file)
            return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._ranks.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def tokenizer_of(tokenizer: str, ranks: str) -> DocumentTokenizer:
    """One tokenizer for all tasks of a worker process."""
    return DocumentTokenizer(tokenizer, ranks)


def _cut(batches: Iterator[pa.RecordBatch], config: PackConfig) -> Iterator[pa.RecordBatch]:
    tokenizer = tokenizer_of(config.tokenizer, config.ranks)
    for batch in batches:
        for part in T.pieces(batch, "text", 1 << 20):
            owner, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.append(tokenizer.encode(text or ""), np.uint32(config.end_id)).astype("<u4")
                head = len(ids) % config.length or config.length
                edges = [0, *range(head, len(ids) + 1, config.length)]
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    owner.append(i), piece.append(p), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def token_pieces(docs: DataFrame, config: PackConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.

    A document is its ids and the end id; null text is empty. Documents longer
    than a sequence are cut into pieces of exactly its length, the first of
    which takes the remainder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _cut(b, config), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_best_fit(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, ranks a sequence, offset) rows.

    Sequences of one class, a run of numbers, hold the same lengths so far.
    Items of a length go to the class with the least room that is enough; a
    class that is used in part is split. Rows are bounded by the number of
    different lengths, as each step leaves at most one split class.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    open_rooms = np.zeros(length + 1, bool)
    plan, sequences = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            fits = np.flatnonzero(open_rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    open_rooms[room] = False
            else:
                room, each = length, length // size
                first, n = sequences, -(-left // each)
                sequences += n
            each = room // size
            full = min(n, left // each)
            take = []
            if full:
                take.append((first, full, each))
            if full < n and left - full * each:
                take.append((first + full, 1, left - full * each))
            used = 0
            for at, m, k in take:
                plan.append((size, rank, m * k, at, k, length - room))
                rank, left, used = rank + m * k, left - m * k, used + m
                rest = room - k * size
                if rest:
                    rooms.setdefault(rest, []).append((at, m))
                    open_rooms[rest] = True
            if used < n:
                rooms.setdefault(room, []).append((first + used, n - used))
                open_rooms[room] = True
    return plan


def assign_slots(pieces: DataFrame, config: PackConfig) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id``, ``piece``, ``length`` and a durable parent.

    Ranks within a length come from hash blocks: a block's first rank is the
    number of pieces in blocks before it, and only a block is sorted, so that a
    length which a third of all pieces share is not one task. The plan has rows
    by length, not by document: it is broadcast.
    """
    counts = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # at most ``config.length`` rows
    plan = plan_best_fit(histogram, config.length)
    blocks = max(1, -(-max(histogram.values(), default=1) // config.block_rows))
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    pieces = pieces.withColumn("__block", block)
    before = pieces.groupBy("length", "__block").count().withColumn(
        "__before", F.sum("count").over(W.partitionBy("length").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    )
    before = before.select(F.col("length").alias("__l"), F.col("__block").alias("__b"), F.coalesce("__before", F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("length", "__block").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("__within", within).join(before, (F.col("length") == F.col("__l")) & (F.col("__block") == F.col("__b")))
    ranked = ranked.withColumn("__rank", F.col("__within") + F.col("__before"))
    schema = Ty.StructType([Ty.StructField(n, Ty.LongType()) for n in ("__len", "__from", "__n", "__seq", "__each", "__off")])
    slots = pieces.sparkSession.createDataFrame(plan, schema)
    found = ranked.join(F.broadcast(slots), (F.col("length") == F.col("__len")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__n")))
    nth = F.col("__rank") - F.col("__from")
    return found.select(
        *[c for c in pieces.columns if c != "__block"],
        (F.col("__seq") + F.floor(nth / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__off") + nth % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, config: PackConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    Sequences are filled from 0 without gaps. Repeated rows are packed as often
    as they occur; an empty table gives an empty result.
    """
    return assign_slots(durable(token_pieces(docs, config, text_col, id_col)), config)
