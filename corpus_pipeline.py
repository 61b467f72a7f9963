"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm import exactdup, langid, mixing, neardup, packing
from oddsloom.llm.queries import pack_config
from oddsloom.session import Scratch

#: Beyond texts without letters, a text goes if fewer of its n-grams than this are known to its best language.
LEAST_SUPPORT = 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; filters are learned from the table's own labels.

    Null texts, texts without a letter and texts that no filter knows go.
    """
    return langid.keep_recognised(docs, langid.fit_filters(docs), LEAST_SUPPORT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, ignoring the case of A-Z: the one of the largest id.

    A null text is an empty one; rows that repeat id and text leave one; rows with a null id stay.
    """
    return exactdup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the smallest id.

    Rows that repeat an id leave one; texts without words are one class; rows with a null id stay.
    """
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, none or twice included; rows are repeated.

    They come shard by shard, each shard in its local order, and are written so.
    A null source is a source, and a null text has no words; rows that repeat an id are drawn alike.
    """
    return mixing.laid_out(mixing.mix_sources(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2048; a null text is empty, repeated rows are packed as often."""
    return packing.pack(docs, pack_config())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Learned models, hashes and a tokenizer take part: no SQL gives these rows. tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again.

    Null texts and texts without a letter go in the first stage; rows that
    repeat a text, or an id with a near text, go in the second and third; a null
    source is a source of the mix; very long texts are read whole and cut into
    pieces by the last stage; an empty table gives an empty result. Columns
    other than those of documents, of any name, stay until the last stage. A
    stage's table goes when the next one is written; the last one, which the
    result reads, when the process ends.
    """
    scratch, before = Scratch(spark, "pipeline"), ""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
