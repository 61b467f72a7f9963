"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so, the distinct chunks are
deduplicated and prove that every chunk identifier stands for one content, and
texts are then compared by their ordered identifier lists. A long text moves
once at most, as its distinct chunks; afterwards only its short recipe moves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.spread import spread_join
from oddsloom.llm.common import one_row_each
from oddsloom.session import durable

#: A chunk ends at the first doubled sign after 256 characters, whatever the script, or after 2048 where there is none.
CHUNK = r"(?s).{256,2046}?(\S)\1|.{1,2048}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tried in turn, narrowest first, until the chunks themselves show no clash; the last is the content.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    lambda c: F.xxhash64(c),
    lambda c: F.sha2(c, 256),
    lambda c: c,
)


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).select(
        "doc_id", "norm", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks")
    )


def clashes(chunks: DataFrame, identifier: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for two different chunks; ``chunks`` has a column ``chunk``."""
    store = chunks.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    return store.groupBy("id").count().where("count > 1")


def recipes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
) -> DataFrame:
    """(doc_id, recipe, text_sha256): each text as its ordered list of verified chunk identifiers.

    Equal normalised texts have equal recipes and different ones have different
    recipes: the chunks of a text, in order, are the text, and an identifier is
    used only after one pass over all distinct chunks found it unambiguous.
    A null or empty text has the empty recipe.
    """
    chunked = _chunked(docs, id_col, text_col)
    chunks = chunked.select(F.explode("chunks").alias("chunk"))
    for identifier in identifiers[:-1]:
        if clashes(chunks, identifier).isEmpty():
            break
    else:
        identifier = identifiers[-1]
    return chunked.select("doc_id", F.transform("chunks", identifier).alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest doc_id of
    a group stays; ids of null stay only where a group has no other. Rows that
    repeat both id and text count in group_size, and all rows with the id that
    stays are marked kept (:func:`drop_copies` leaves one of them). An empty
    table gives an empty result; other columns are not looked at.
    """
    table = durable(recipes(docs, id_col, text_col, **how))
    groups = table.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return spread_join(table, groups, ["recipe"], "doc_id").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each different text, that of the largest id, all columns kept.

    Rows that repeat id and text are copies of one another too; of those, the
    first by its JSON text stays. Ids of null are kept as they have no key to be
    found by. A null or empty text is a text like any other; an empty table
    gives an empty result. Columns of any other name may be there.
    """
    table = durable(recipes(docs, id_col, text_col))
    groups = table.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    lost = (
        spread_join(table, groups.where("size > 1"), ["recipe"], "doc_id")
        .where(F.col("doc_id") < F.col("keep"))
        .select(F.col("doc_id").alias("__lost"), F.col("text_sha256").alias("__sha"))
        .distinct()
    )
    repeated = not table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        return docs.join(lost, docs[id_col] == F.col("__lost"), "left_anti")
    named = docs.withColumn("__own", F.sha2(normalised(docs[text_col]), 256))
    left = named.join(lost, (F.col(id_col) == F.col("__lost")) & (F.col("__own") == F.col("__sha")), "left_anti")
    return one_row_each(left, [id_col, "__own"]).drop("__own")
