"""A query session over a stored history: questions that stream in read the totals of their own keys alone.

The history of a key set is kept as running totals: one row for each key and
time, with everything up to that time added up. What was known before a
question's time is then its key's last row before it. Rows lie in parts by key
hash, so that a batch of questions reads the parts that its keys fall into and
nothing else of the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from oddsloom.functions import shrink
from oddsloom.functions.asof import hot_keys, prior_state
from oddsloom.operators import logit, veto
from oddsloom.operators.features import Tables
from oddsloom.plans.predict import with_series
from oddsloom.streaming import streams

#: One line of JSON for each question; ``seed`` says which draws it wants.
SERIES_QUESTION = "match_id STRING, team1_id STRING, team2_id STRING, best_of INT, seed BIGINT, ts TIMESTAMP_NTZ"


#: Tasks that the rows of one part are dealt to at most.
TASKS_A_PART = 4


@dataclass(frozen=True)
class Snapshot:
    """Running totals of one key set in a folder of Parquet files, ``parts`` of them by key hash."""

    path: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    parts: int

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def before(self, questions: DataFrame, prefix: str = "") -> DataFrame:
        """``questions`` (keys and ts) with the totals of strictly earlier events, 0 without any.

        Which parts are read is a filter on the folder's partitions, made from
        the keys that are asked for: ``parts`` numbers at most.
        """
        asked = [r[0] for r in questions.select(self.part().alias("part")).distinct().collect()]
        history = questions.sparkSession.read.parquet(self.path).where(F.col("part").isin(asked))
        read = prior_state(questions, history, list(self.keys), lasts={"__state": F.struct(*self.sums)})
        return read.select(*questions.columns, *[F.coalesce(F.col("__state")[n], F.lit(0)).alias(prefix + n) for n in self.sums])


def store_snapshot(events: DataFrame, path: str, keys: Sequence[str], sums: Mapping[str, str | Column], parts: int = 64, ts: str = "ts") -> Snapshot:
    """Write the running totals of ``events`` by key and time. Events without a key or time are left out; hot keys are parted by time as in any read."""
    known = F.col(ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    events, out = events.where(known).withColumn("ts", F.col(ts)), Snapshot(path, tuple(keys), tuple(sums), parts)
    if keys and hot_keys(events, list(keys)[:1]) is None:
        # Rows are dealt once, by what they are written by; a key's are together.
        own = ["part", "__task", *keys]
        dealt = events.withColumns({"part": out.part(), "__task": F.pmod(F.shiftright(F.xxhash64(*keys), 32), F.lit(TASKS_A_PART))}).repartition(parts * TASKS_A_PART, "part", "__task")
        at = dealt.groupBy(*own, "ts").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
        upto = W.partitionBy(*own).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        rows = at.select("part", *keys, "ts", *[F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(n) for n in sums])
        rows.sortWithinPartitions("part", *keys, "ts").write.mode("overwrite").partitionBy("part").parquet(path)
        return out
    at = events.groupBy(*keys, "ts").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    read = prior_state(at, at, list(keys), sums={n: f"__{n}" for n in sums}, hot=hot_keys(at, list(keys)[:1]))
    rows = read.select(*keys, "ts", *[(F.col(n) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in sums]).withColumn("part", out.part())
    # A part's rows are dealt to a few tasks, so that no task writes all of a hot key.
    rows.repartition("part", F.pmod(F.xxhash64("ts"), F.lit(TASKS_A_PART))).sortWithinPartitions(*keys, "ts").write.mode("overwrite").partitionBy("part").parquet(path)
    return out


@dataclass(frozen=True)
class MapSnapshot:
    """Totals by team and map of the pool, read from the rows of the team."""

    whole: Snapshot
    pool: tuple[str, ...]

    def before(self, questions: DataFrame, prefix: str = "") -> DataFrame:
        """``questions`` (team_id, map_name and ts) with the totals of strictly earlier events, 0 without any and for maps beyond the pool."""
        at = F.array_position(F.array(*[F.lit(m) for m in self.pool]), F.col("map_name")).cast("int") - 1
        read = self.whole.before(questions, "__")
        found = {n: F.get(F.array(*[F.col(f"__{n}_{i}") for i in range(len(self.pool))]), at) for n in ("wins", "games")}
        return read.select(*questions.columns, *[F.coalesce(c, F.lit(0)).alias(prefix + n) for n, c in found.items()])


@dataclass(frozen=True)
class Session:
    """Stored totals by team and map, in one row for each team and time, and of the league, and the pool of maps: all that a question needs."""

    totals: Snapshot
    league: Snapshot
    pool: tuple[str, ...]
    k: float = 10.0
    n_samples: int = 20

    @property
    def team(self) -> Snapshot:
        """The totals over all maps, from the same files."""
        return replace(self.totals, sums=("wins", "games"))

    @property
    def team_map(self) -> MapSnapshot:
        return MapSnapshot(self.totals, self.pool)

    @classmethod
    def store(cls, t: Tables, folder: str, pool: Sequence[str], parts: int = 64, n_samples: int = 20) -> Session:
        """Write the history of a league's finished maps under ``folder``."""
        ledger, names = t.seat_ledger(), tuple(sorted(pool))
        one = ledger.where("seat = 1").withColumn("league", F.lit("all"))
        sums: dict[str, str | Column] = {"wins": "won", "games": F.lit(1)}
        for i, name in enumerate(names):
            here = F.col("map_name") == name
            sums |= {f"wins_{i}": F.when(here, F.col("won")), f"games_{i}": F.when(here, 1)}
        return cls(
            store_snapshot(ledger, f"{folder}/team", ["team_id"], sums, parts),
            store_snapshot(one, f"{folder}/league", ["league"], {"ots": "ot", "maps": F.lit(1)}, 1),
            names, n_samples=n_samples,
        )

    def _by_match(self, questions: DataFrame) -> DataFrame:
        """(match_id, cells, a_overall, b_overall): one row a question, with both sides' rates on each map of the pool in ``cells``.

        A side is one row, read and dealt once, and meets the other by match.
        """
        both = F.array(F.struct(F.lit(1).alias("side"), F.col("team1_id").alias("team_id")), F.struct(F.lit(2).alias("side"), F.col("team2_id").alias("team_id")))
        read = self.totals.before(questions.select("match_id", "ts", F.inline(both)))
        prior = shrink.rate(F.col("wins"), F.col("games"), 0.5)
        rates = {f"r{i}": shrink.beta_mean(F.col(f"wins_{i}"), F.col(f"games_{i}"), F.col("overall"), self.k) for i in range(len(self.pool))}
        sides = read.withColumn("overall", prior).select("match_id", "side", "overall", *[c.alias(n) for n, c in rates.items()])
        own = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
        met = sides.repartition("match_id").groupBy("match_id").agg(*[own(s, c) for c in ("overall", *rates) for s in (1, 2)])
        cells = F.array(*[F.struct(F.lit(m).alias("map_name"), F.col(f"r{i}_1").alias("a"), F.col(f"r{i}_2").alias("b")) for i, m in enumerate(self.pool)])
        return met.select("match_id", cells.alias("cells"), F.col("overall_1").alias("a_overall"), F.col("overall_2").alias("b_overall"))

    def win_rates(self, questions: DataFrame) -> DataFrame:
        """(match_id, map_name, a, b): both sides' shrunk win rates before the question's time."""
        return self._by_match(questions).select("match_id", F.inline("cells"))

    def rates(self, questions: DataFrame) -> DataFrame:
        """(match_id, map_name, a, b, a_overall, b_overall, p): both sides' shrunk win rates before the question's time and four-way chances from them."""
        league = self.league.before(questions.select("match_id", "ts", F.lit("all").alias("league"))).select("match_id", shrink.rate(F.col("ots"), F.col("maps"), 0.0).alias("ot"))
        read = self._by_match(questions).join(league, "match_id").select("match_id", F.inline("cells"), "a_overall", "b_overall", "ot")
        return read.select("match_id", "map_name", "a", "b", "a_overall", "b_overall", logit.four_way_baseline(F.col("a"), F.col("b"), F.col("ot")).alias("p"))

    def answer(self, questions: DataFrame) -> DataFrame:
        """(match_id, seed, best_of, probabilities): scorelines over sampled vetoes, the sides going by their own rates.

        Draws depend on the question's number and seed alone, so an answer is
        the same in whatever batch it comes, and after a restart. Questions
        that repeat number and seed are answered once.
        """
        asked = questions.dropDuplicates(["match_id", "seed"]).withColumn("question", F.concat_ws("#", "match_id", F.coalesce("seed", F.lit(0)).cast("string")))
        rates = self.rates(questions.dropDuplicates(["match_id"]))
        cells = asked.select("question", "match_id", F.posexplode(veto.script(F.col("best_of"))).alias("step", "action")).where("action <> 'decider'").join(rates, "match_id")
        own = F.when(F.col("step") % 2 == 0, F.col("a")).otherwise(F.col("b"))
        scores = cells.select("question", "step", "map_name", F.when(F.col("action") == "ban", -own).otherwise(own).alias("score"))
        drawn = veto.sample_vetoes(scores, self.n_samples, 0, len(self.pool), "question").withColumnRenamed("question", "match_id")
        fixtures = asked.select(F.col("question").alias("match_id"), "best_of")
        maps = asked.select("question", F.col("match_id").alias("m")).join(rates.withColumnRenamed("match_id", "m"), "m").select(F.col("question").alias("match_id"), "map_name", "p")
        series = veto.mixture(with_series(drawn, fixtures, maps), "match_id", "p", "v")
        return asked.join(series.withColumnRenamed("match_id", "question"), "question").select("match_id", "seed", "best_of", "probabilities")


def answer_questions(spark: SparkSession, session: Session, inbox: str, outbox: str, state: str) -> None:
    """Answer all lines of JSON that lie in ``inbox``, batch by batch, and stop; a restart goes on behind the last batch that was written."""
    streams.answer_all(streams.json_lines(spark, inbox, SERIES_QUESTION), session.answer, outbox, state)


def serve(spark: SparkSession, session: Session, inbox: str, outbox: str, state: str) -> StreamingQuery:
    """The same as a stream that goes on."""
    return streams.answer_stream(streams.json_lines(spark, inbox, SERIES_QUESTION), session.answer, outbox, state)
