"""Streams: a query stream over static history, and running totals kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oddsloom.functions.guards import positive_int

#: One line of JSON for each question.
QUESTION = "match_id STRING, map_index INT, map_name STRING, team1_id STRING, team2_id STRING, ts TIMESTAMP_NTZ"


def json_lines(spark: SparkSession, path: str, schema: str = QUESTION, files: int = 10) -> DataFrame:
    """A stream of JSON lines from a folder; lines that cannot be read become rows of nulls and are left out."""
    text = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    first = schema.split()[0]
    return text.select(F.from_json("value", schema).alias("q")).select("q.*").where(F.col(first).isNotNull())


def files_for_batches(spark: SparkSession, path: str, batches: int) -> int:
    """How many files a batch must take for all that lie in a folder to be answered in so many batches at most.

    A batch whose questions touch the whole history reads all of it, so with a
    fixed number of files the work would grow with their number times the history.
    """
    inside = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in inside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(inside)]
    return max(1, -(-sum(not n.startswith(("_", ".")) for n in names) // positive_int(batches, "batches")))


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Answer each micro-batch with ``answer`` over static history; results are written once, by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def answer_all(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Answer all that has arrived, in batches, and stop; a restart goes on behind the last batch that was written."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Counts and sums by time window and key; rows later than the watermark are not counted."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, lateness).groupBy(window.alias("window"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def running_state(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each micro-batch, from totals kept as state by key."""

    def add(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value).groupBy(key).applyInPandasWithState(add, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
