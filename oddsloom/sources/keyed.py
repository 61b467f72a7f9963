"""Tables with one row a key, in parts by key hash: an upsert rewrites the parts of its keys, a point read scans them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from oddsloom.functions.guards import IntegrityError, positive_int
from oddsloom.sources.documents import stale, upsert

PART = "part"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``key`` under ``path``, the latest of a key by ``at``; ``parts`` is fixed with the first write.

    A part is one folder of Parquet files. Writers must not run at the same
    time. A write puts its parts in place when all of its tasks are done, so a
    reader never sees half a part, and lost tasks are simply run again.
    """

    spark: SparkSession
    path: str
    key: str
    at: str
    parts: int = 64

    def __post_init__(self) -> None:
        positive_int(self.parts, "parts")

    def part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int")

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        """All rows, without the part; the whole table is scanned."""
        return self.spark.read.parquet(self.path).drop(PART)

    def keys(self) -> DataFrame:
        """All keys; no other column is read."""
        return self.spark.read.parquet(self.path).select(self.key)

    def _parts_of(self, keys: DataFrame) -> list[int]:
        """The parts that hold these keys: at most ``parts`` numbers."""
        return sorted(r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.part().alias("p")).distinct().collect())

    def _in_parts(self, parts: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col(PART).isin(parts))

    def get(self, keys: Sequence | DataFrame) -> DataFrame:
        """The rows of ``keys``, a list or a table of them; keys without a row, and null ones, are passed over.

        Only the parts that the keys fall into are scanned.
        """
        if not isinstance(keys, DataFrame):
            kind = Ty.StructType([Ty.StructField(self.key, self.spark.read.parquet(self.path).schema[self.key].dataType)])
            keys = self.spark.createDataFrame([(k,) for k in keys], kind)
        asked = keys.select(self.key).distinct()
        return self._in_parts(self._parts_of(asked)).join(asked, self.key, "left_semi").drop(PART)

    def put(self, new: DataFrame) -> list[int]:
        """Put in the rows of ``new``, or over those of the same key; the parts that were written.

        Of several new rows of a key, the latest by ``at`` counts, ties by the
        row's JSON text. Rows without a key fail. Parts of other keys are neither
        read nor written; no rows write nothing.
        """
        if not new.where(F.col(self.key).isNull()).isEmpty():
            raise IntegrityError(f"rows without a {self.key}")
        touched = self._parts_of(new)
        if not touched:
            return []
        try:
            old = self._in_parts(touched).drop(PART) if self.exists() else new.limit(0)
        except AnalysisException:
            # A folder without a file yet.
            old = new.limit(0)
        if set(old.columns) != set(new.columns):
            raise IntegrityError(f"the table has the columns {sorted(old.columns)}, not {sorted(new.columns)}")
        self._write(upsert(old.select(*new.columns), new, self.key, self.at))
        return touched

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.withColumn(PART, self.part()).repartition(PART, F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(4)))
        dealt.sortWithinPartitions(PART, self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def missing(self, wanted: DataFrame, now: Column | None = None, ttl_seconds: float | None = None) -> DataFrame:
        """Wanted keys that the table lacks or holds too old; only their parts are scanned."""
        asked = wanted.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        if not self.exists():
            return asked
        held = self._in_parts(self._parts_of(asked))
        good = held.where(~stale(F.col(self.at).cast("timestamp"), now if now is not None else F.current_timestamp(), ttl_seconds))
        return asked.join(good, self.key, "left_anti")
