"""The wire form of predictions: a typed schema, checks that name what is wrong, and a sink that takes only what passes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.guards import IntegrityError

_BAND = "ARRAY<DOUBLE>"
_ACTION = "STRUCT<step_index: INT, team_id: STRING, team_name: STRING, action: STRING, map_name: STRING>"
_MAP = f"STRUCT<map_index: INT, map_name: STRING, probabilities: ARRAY<DOUBLE>, low: {_BAND}, high: {_BAND}, p_a: DOUBLE, p_overtime: DOUBLE>"
_DERIVED = "STRUCT<p_series: DOUBLE, likeliest: STRING, p_likeliest: DOUBLE, p_distance: DOUBLE>"
_OVERALL = f"STRUCT<scoreline_labels: ARRAY<STRING>, probabilities: ARRAY<DOUBLE>, derived: {_DERIVED}, maps: ARRAY<{_MAP}>, greedy_veto: ARRAY<{_ACTION}>>"
_RANKED = "STRUCT<rank: INT, sequence: ARRAY<STRING>, played: ARRAY<STRING>, p: DOUBLE, p_series: DOUBLE>"
_LEVERAGE = "STRUCT<map_name: STRING, p_played: DOUBLE, swing: DOUBLE>"
_SENSITIVITY = "STRUCT<n: BIGINT, mean: DOUBLE, variance: DOUBLE, low: DOUBLE, high: DOUBLE>"
#: One row for each fixture.
FIXTURE = (
    "match_id STRING, event_name STRING, scheduled_at STRING, best_of INT, team_a STRUCT<id: STRING, name: STRING>, team_b STRUCT<id: STRING, name: STRING>, "
    f"overall {_OVERALL}, ranked_vetoes ARRAY<{_RANKED}>, leverage ARRAY<{_LEVERAGE}>, sensitivity {_SENSITIVITY}, coverage_gap DOUBLE"
)
#: The keys of the root record beside its fixtures.
ROOT = ("schema_version", "generated_at", "model_version", "dataset_version", "knobs", "intervals_present")
TOLERANCE = 1e-6


def _chance(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x >= -TOLERANCE) & (x <= 1 + TOLERANCE)


def _vector(v: Column) -> Column:
    return F.forall(v, _chance) & (F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) - 1.0) <= 1e-3)


def breaches(fixtures: DataFrame) -> DataFrame:
    """(match_id, reason) of fixtures that break the contract: the first reason of each.

    Fields that must be there, labels as many as chances and as many as a series
    of that length has, chances in [0, 1] that add up to 1, bands around their
    chances, the maps of a sequence once each, ranks from 1, and unique ids.
    """
    o = F.col("overall")
    bands = F.exists(o["maps"], lambda m: m["low"].isNotNull() & ((F.size(m["low"]) != F.size(m["probabilities"])) | F.exists(F.arrays_zip(m["low"].alias("l"), m["high"].alias("h")), lambda b: b["l"] > b["h"])))
    rules = {
        "a required field is missing": F.col("match_id").isNull() | F.col("scheduled_at").isNull() | F.col("best_of").isNull() | F.col("team_a")["id"].isNull() | F.col("team_b")["id"].isNull() | o.isNull(),
        "a team plays itself": F.col("team_a")["id"] == F.col("team_b")["id"],
        "the series has no odd length": (F.col("best_of") < 1) | (F.col("best_of") % 2 == 0),
        "scorelines and chances differ in number": (F.size(o["scoreline_labels"]) != F.size(o["probabilities"])) | (F.size(o["probabilities"]) != F.col("best_of") + 1),
        "scoreline chances are none": ~_vector(o["probabilities"]),
        "map chances are none": F.exists(o["maps"], lambda m: m["probabilities"].isNull() | ~_vector(m["probabilities"])),
        "a band is upside down": bands,
        "a veto repeats a map": F.exists(F.coalesce("ranked_vetoes", F.array().cast(f"array<{_RANKED}>")), lambda v: F.size(F.array_distinct(v["sequence"])) != F.size(v["sequence"])),
        "ranks do not count from 1": ~F.coalesce(F.transform("ranked_vetoes", lambda v: v["rank"]) == F.transform("ranked_vetoes", lambda _, i: i + 1), F.lit(True)),
        "derived values disagree": F.abs(o["derived"]["p_likeliest"] - F.array_max(o["probabilities"])) > TOLERANCE,
    }
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    again = fixtures.groupBy("match_id").count().where("count > 1 and match_id is not null").select("match_id", F.lit("a fixture is there twice").alias("reason"))
    return fixtures.withColumn("reason", reason).where("reason is not null").select("match_id", "reason").unionByName(again)


def write_artifact(fixtures: DataFrame, root: dict, path: str) -> None:
    """The root record and its fixtures under ``path``, put in place in one step, after the checks.

    Fixtures are JSON lines written by the tasks; the root record, a few values,
    is one file beside them. Nothing appears at ``path`` if a check fails.
    """
    missing = [k for k in ROOT if k not in root]
    if missing:
        raise IntegrityError(f"the root record lacks {missing}")
    typed = fixtures.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fixtures.sparkSession.createDataFrame([], FIXTURE).schema])
    some = breaches(typed).limit(5).collect()
    if some:
        raise IntegrityError(f"fixtures break the contract: {[tuple(r) for r in some]}")
    spark = fixtures.sparkSession
    jvm = spark._jvm
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    typed.write.json(f"{temporary}/fixtures")
    out = fs.create(jvm.org.apache.hadoop.fs.Path(temporary, "root.json"))
    out.write(bytearray(json.dumps(root, sort_keys=True).encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(temporary, target)


def read_artifact(spark, path: str) -> tuple[dict, DataFrame]:
    """(root record, typed fixtures) of an artifact."""
    root = json.loads(spark.read.text(f"{path}/root.json", wholetext=True).first()[0])
    return root, spark.read.schema(FIXTURE).json(f"{path}/fixtures")
