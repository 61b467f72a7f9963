"""Predictions of coming series: sampled vetoes, map chances, scorelines, ranked vetoes, leverage and sensitivity.

All fixtures go through one plan. A map's chances are made once for each fixture
and map of the pool; samples and ranked sequences meet them by a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import scoring, series
from oddsloom.operators import logit, presentation, series_eval, veto, veto_exact, veto_steps
from oddsloom.operators.features import Tables
from oddsloom.plans import jobs
from oddsloom.session import durable


@dataclass(frozen=True)
class Knobs:
    """Sampled sequences a fixture, their seed, the width of bands and the number of ranked vetoes."""

    n_samples: int = 50
    seed: int = 7
    level: float = 0.9
    top_n: int = 5


@dataclass
class Predictor:
    """Fitted models over the tables of a league; it answers any number of fixture tables, and keeps the stored ledgers between them."""

    tables: Tables
    trained: jobs.Trained
    choices: Mapping[str, logit.LogitModel]
    pool: Sequence[str]
    knobs: Knobs = field(default_factory=Knobs)
    replicates: Sequence[logit.LogitModel] = ()

    def answer(self, fixtures: DataFrame) -> Forecast:
        """The forecast of ``fixtures``: match_id, ts, event_name, best_of (a number), team1_id and team2_id."""
        chances = jobs.map_chances(fixtures.select("match_id", "ts", "event_name", "team1_id", "team2_id"), list(self.pool), self.tables, self.trained, self.replicates, self.knobs.level)
        maps, scores = durable(chances), durable(veto_steps.utilities(fixtures, self.tables, self.choices, self.pool))
        drawn = veto.sample_vetoes(scores, self.knobs.n_samples, self.knobs.seed, len(self.pool))
        return Forecast(self, fixtures, maps, scores, durable(with_series(drawn, fixtures, maps)))


def with_series(sequences: DataFrame, fixtures: DataFrame, maps: DataFrame) -> DataFrame:
    """Sequences with what they play, the scorelines ``v`` of that and side A's chance of the series."""
    side = F.map_from_entries(F.collect_list(F.struct("map_name", scoring.side_a(F.col("p")).alias("a")))).alias("side")
    rows = sequences.join(fixtures.select("match_id", "best_of"), "match_id").withColumn("played", veto.played_maps(F.col("sequence"), F.col("best_of")))
    rows = rows.join(maps.groupBy("match_id").agg(side), "match_id")
    vector = series_vector(F.transform("played", lambda m: F.element_at("side", m)), F.col("best_of"))
    return rows.withColumn("v", vector).withColumn("p_series", series.series_win(F.col("v"))).drop("side")


def series_vector(p: Column, best_of: Column) -> Column:
    """Scorelines of a series from the chances of its maps, by the row's length."""
    return series_eval.by_length(best_of, lambda n: series.scorelines(p, n), F.lit(None).cast("array<double>"))


@dataclass
class Forecast:
    """What :meth:`Predictor.answer` found: map chances, the scores of veto steps and sampled vetoes; the rest is made from them."""

    predictor: Predictor
    fixtures: DataFrame
    maps: DataFrame
    scores: DataFrame
    samples: DataFrame

    def series(self) -> DataFrame:
        """(match_id, probabilities): scorelines averaged over the samples by their sequences' chances."""
        return veto.mixture(self.samples, "match_id", "p", "v")

    def bands(self) -> DataFrame:
        """(match_id, n, mean, low, high): the series chance over the replicates' models, exact over all vetoes; no rows without replicates."""
        wins = self.maps.where("sides is not null").select("match_id", "map_name", F.transform("sides", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).alias("a"))
        known = wins.select("match_id").distinct()
        return veto_exact.series_bands(self.scores.join(known, "match_id", "left_semi"), wins, self.fixtures, self.predictor.knobs.level)

    def sensitivity(self) -> DataFrame:
        """How far the series chance moves with the veto."""
        return series_eval.sensitivity(self.samples, level=self.predictor.knobs.level)

    def ranked(self) -> DataFrame:
        """(match_id, rank, sequence, played, p, p_series): the likeliest of all sequences, ties by the sequence."""
        top = veto_exact.top_sequences(self.scores, self.predictor.knobs.top_n)
        return with_series(top, self.fixtures, self.maps).select("match_id", "rank", "sequence", "played", "p", "p_series")

    def exact(self) -> DataFrame:
        """(match_id, best_of, probabilities, leverage) over all sequences, without sampling."""
        wins = self.maps.select("match_id", "map_name", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scoring.side_a(F.col("p")))).alias("a"))
        return veto_exact.exact_series(self.scores, wins, self.fixtures)

    def coverage(self) -> DataFrame:
        """(match_id, coverage_gap): the ranked sequences' weighted series chance less the overall one; null without mass."""
        listed = self.ranked().groupBy("match_id").agg(F.try_divide(F.sum(F.col("p") * F.col("p_series")), F.sum("p")).alias("listed"))
        overall = self.series().select("match_id", series.series_win(F.col("probabilities")).alias("overall"))
        return listed.join(overall, "match_id").select("match_id", (F.col("listed") - F.col("overall")).alias("coverage_gap"))

    def leverage(self) -> DataFrame:
        """(match_id, map_name, p_played, swing): how much the series chance moves with a map being played, over all sequences."""
        return self.exact().select("match_id", F.inline("leverage"))

    def greedy(self) -> DataFrame:
        """(match_id, step, side, action, map_name): the veto in which both sides go by their shrunk win rates."""
        one = self.fixtures.select("match_id", "best_of", "ts", F.col("team1_id").alias("team_id"), F.col("team2_id").alias("opponent_id"), F.explode(F.array(*[F.lit(m) for m in sorted(self.predictor.pool)])).alias("map_name"))
        rated = veto_steps.with_rates(one, self.predictor.tables)
        return veto.greedy_vetoes(rated.select("match_id", "best_of", "map_name", F.col("own_rate").alias("a"), F.col("other_rate").alias("b")))

    def artifact(self) -> DataFrame:
        """One row for each fixture in the form of :mod:`oddsloom.operators.contract`."""
        names = presentation.display_names(self.predictor.tables.matches)
        a = names.select(F.col("team_id").alias("team1_id"), F.col("team_name").alias("a_name"))
        b = names.select(F.col("team_id").alias("team2_id"), F.col("team_name").alias("b_name"))
        cell = F.struct(F.array_position(F.array(*[F.lit(m) for m in sorted(self.predictor.pool)]), F.col("map_name")).cast("int").alias("map_index"), "map_name", F.col("p").alias("probabilities"), "low", "high", scoring.side_a(F.col("p")).alias("p_a"), (F.col("p")[1] + F.col("p")[2]).alias("p_overtime"))
        own = self.maps.groupBy("match_id").agg(F.array_sort(F.collect_list(cell)).alias("maps"))
        ranked = self.ranked().groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sequence", "played", "p", "p_series"))).alias("ranked_vetoes"))
        swings = self.leverage().groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("map_name", "p_played", "swing"))).alias("leverage"))
        moved = self.sensitivity().select("match_id", F.struct("n", "mean", "variance", "low", "high").alias("sensitivity"))
        team = F.when(F.col("side") == "A", F.struct(F.col("team1_id").alias("i"), F.col("a_name").alias("n"))).when(F.col("side") == "B", F.struct(F.col("team2_id").alias("i"), F.col("b_name").alias("n")))
        base = self.fixtures.join(a, "team1_id", "left").join(b, "team2_id", "left")
        steps = self.greedy().join(base.select("match_id", "team1_id", "team2_id", "a_name", "b_name"), "match_id").withColumn("t", team)
        greedy = steps.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(F.col("step").alias("step_index"), F.col("t.i").alias("team_id"), F.col("t.n").alias("team_name"), "action", "map_name"))).alias("greedy_veto"))
        rows = base
        for part in (self.series(), own, ranked, swings, moved, greedy, self.coverage()):
            rows = rows.join(part, "match_id", "left")
        v = F.col("probabilities")
        labels = series_eval.by_length(F.col("best_of"), lambda n: F.array(*[F.lit(x) for x in presentation.scoreline_labels(n)]), F.lit(None).cast("array<string>"))
        kind = "struct<p_series:double,likeliest:string,p_likeliest:double,p_distance:double>"
        derived = series_eval.by_length(F.col("best_of"), lambda n: presentation.derived(v, n).cast(kind), F.lit(None).cast(kind))
        return rows.select(
            "match_id", "event_name", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("scheduled_at"), F.col("best_of").cast("int").alias("best_of"),
            F.struct(F.col("team1_id").alias("id"), F.col("a_name").alias("name")).alias("team_a"), F.struct(F.col("team2_id").alias("id"), F.col("b_name").alias("name")).alias("team_b"),
            F.struct(labels.alias("scoreline_labels"), v.alias("probabilities"), derived.alias("derived"), "maps", "greedy_veto").alias("overall"),
            "ranked_vetoes", "leverage", "sensitivity", "coverage_gap",
        )
