"""Nested match documents: reading, checking, and flattening to four tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql import Window as W

from oddsloom.functions import names
from oddsloom.operators.seats import above_regulation, legality
from oddsloom.operators.veto import SCRIPTS

TEAM = "STRUCT<name: STRING, team_id: STRING>"
PLAYER = (
    "STRUCT<player_name: STRING, team_name: STRING, rating: DOUBLE, acs: DOUBLE, kills: INT, deaths: INT, assists: INT, adr: DOUBLE, kast: DOUBLE, "
    "hs_pct: DOUBLE, first_kills: INT, first_deaths: INT, agents: ARRAY<STRING>>"
)
ROUNDS = [f"team{s}_{x}_rounds" for s in (1, 2) for x in ("first_half", "second_half", "atk", "def")]
MAP = (
    "STRUCT<map_name: STRING, team1_score: INT, team2_score: INT, winner: STRING, duration: STRING, agent_picks: MAP<STRING, ARRAY<STRING>>, "
    f"player_stats: ARRAY<{PLAYER}>, {', '.join(f'{r}: INT' for r in ROUNDS)}>"
)
VETO = "STRUCT<step_index: INT, team: STRING, action: STRING, map_name: STRING>"
#: The document's schema; its JSON text is read with it.
MATCH = (
    f"STRUCT<match_id: STRING, url: STRING, event_name: STRING, date: STRING, team1: {TEAM}, team2: {TEAM}, team1_score: INT, team2_score: INT, best_of: STRING, "
    f"maps: ARRAY<{MAP}>, veto_actions: ARRAY<{VETO}>, status: STRING>"
)


def parse(cached: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(documents with a column ``m``, quarantine with a reason) from JSON text.

    Text that is no document, or without an id or teams, is set aside; so are
    documents with a map whose finished score is illegal.
    """
    read = cached.withColumn("m", F.from_json(data, MATCH, {"mode": "PERMISSIVE"}))
    hi, lo = (lambda x: F.greatest(x["team1_score"], x["team2_score"])), (lambda x: F.least(x["team1_score"], x["team2_score"]))
    illegal = F.exists(F.coalesce("m.maps", F.array().cast(f"array<{MAP}>")), lambda x: x["winner"].isNotNull() & F.coalesce((hi(x) < 13) | ((lo(x) >= 12) & (hi(x) - lo(x) != 2)) | ((lo(x) < 12) & (hi(x) != 13)), F.lit(True)))
    reason = F.when(F.col("m.match_id").isNull() | F.col("m.team1").isNull() | F.col("m.team2").isNull(), "not a match").when(illegal, "illegal score")
    read = read.withColumn("reason", reason)
    return read.where("reason is null").drop("reason"), read.where("reason is not null").drop("m")


def flatten_matches(docs: DataFrame) -> DataFrame:
    """Twelve columns and ``ts``, the parsed time; a date that is none fails the job."""
    m = F.col("m")
    return docs.select(
        m["match_id"].alias("match_id"), m["url"].alias("url"), m["event_name"].alias("event_name"), m["date"].alias("date"), m["team1"]["name"].alias("team1_name"),
        m["team1"]["team_id"].alias("team1_id"), m["team2"]["name"].alias("team2_name"), m["team2"]["team_id"].alias("team2_id"), m["team1_score"].alias("team1_score"),
        m["team2_score"].alias("team2_score"), m["best_of"].alias("best_of"), m["status"].alias("status"), F.to_timestamp_ntz(m["date"]).alias("ts"),
    )


def flatten_maps(docs: DataFrame) -> DataFrame:
    """One row for each finished map, at its place in the document; unfinished ones are left out and leave a gap."""
    rows = docs.select(F.col("m.match_id").alias("match_id"), F.posexplode("m.maps").alias("map_index", "x")).where("x.winner is not null")
    return rows.select(
        "match_id", "map_index", names.map_name(F.col("x.map_name")).alias("map_name"), "x.team1_score", "x.team2_score", "x.winner", "x.duration", *[f"x.{r}" for r in ROUNDS]
    )


def flatten_players(docs: DataFrame) -> DataFrame:
    """One row for each player of a finished map; agents as JSON text."""
    rows = docs.select(F.col("m.match_id").alias("match_id"), F.posexplode("m.maps").alias("map_index", "x")).where("x.winner is not null")
    rows = rows.select("match_id", "map_index", F.inline("x.player_stats"))
    return rows.select("match_id", "map_index", *[c for c in rows.columns[2:] if c != "agents"], F.to_json(F.coalesce("agents", F.array().cast("array<string>"))).alias("agents_json"))


def flatten_vetoes(docs: DataFrame) -> DataFrame:
    """One row for each step of a veto."""
    return docs.select(F.col("m.match_id").alias("match_id"), F.inline("m.veto_actions")).withColumn("map_name", names.map_name(F.col("map_name")))


def materialize(cached: DataFrame, out: str, data: str = "data") -> None:
    """Write the four tables and the quarantine under ``out``."""
    docs, aside = parse(cached, data)
    for name, flat in (("matches", flatten_matches), ("maps", flatten_maps), ("player_map_stats", flatten_players), ("veto_actions", flatten_vetoes)):
        flat(docs).write.mode("overwrite").parquet(f"{out}/{name}")
    aside.write.mode("overwrite").parquet(f"{out}/quarantine")


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in or over by key; of several new rows, the latest by ``at``, ties by the row's JSON text."""
    whole = F.struct(*new.columns)
    fresh = new.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, F.struct(F.col(at), F.to_json(whole))).alias("__row")).select("__row.*")
    return old.join(fresh, key, "left_anti").unionByName(fresh)


def stale(at: Column, now: Column, ttl_seconds: float | None) -> Column:
    """Whether a cached row is too old: never without a limit, always without a time."""
    if ttl_seconds is None:
        return F.lit(False)
    return F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) > F.lit(int(ttl_seconds * 1_000_000)), F.lit(True))


def to_fetch(wanted: DataFrame, cache: DataFrame, key: str = "url", at: str = "fetched_at", now: Column | None = None, ttl_seconds: float | None = None) -> DataFrame:
    """Wanted keys that the cache lacks or holds too old."""
    good = cache.where(~stale(F.col(at).cast("timestamp"), now if now is not None else F.current_timestamp(), ttl_seconds))
    return wanted.join(good, key, "left_anti")


def veto_steps(notes: DataFrame, key: str = "match_id", note: str = "note") -> DataFrame:
    """(key, step_index, team, action, map_name) from notes such as ``AAA ban Haven; BBB pick Lotus; Split remains``.

    Parts that are neither a ban, a pick nor a remaining map are passed over; steps count those that stay.
    """
    parts = notes.select(key, F.posexplode(F.split(note, ";")).alias("__i", "__p")).withColumn("__p", F.trim("__p"))
    acted, rest = r"(?i)^(\S.*?)\s+(ban|pick)s?\s+(\S.*)$", r"(?i)^(\S.*?)\s+remains?$"
    action = F.lower(F.regexp_extract("__p", acted, 2))
    decider = F.regexp_extract("__p", rest, 1)
    rows = parts.select(
        key, "__i",
        F.when(action != "", F.regexp_extract("__p", acted, 1)).alias("team"), F.when(action != "", action).when(decider != "", "decider").alias("action"),
        names.map_name(F.when(action != "", F.regexp_extract("__p", acted, 3)).otherwise(decider)).alias("map_name"),
    ).where("action is not null")
    nth = F.row_number().over(W.partitionBy(key).orderBy("__i")) - 1
    return rows.select(key, nth.alias("step_index"), "team", "action", "map_name")


#: Links to pages of matches: their path begins with the match's number.
MATCH_LINK = r'href="(/\d+/[^"]*)"'


def event_links(pages: DataFrame, key: str = "url", html: str = "html", pattern: str = MATCH_LINK) -> DataFrame:
    """(key, match_url, nth) of the distinct links of event pages that fit ``pattern``, in order of first sight."""
    links = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("__i", "match_url"))
    first = links.groupBy(key, "match_url").agg(F.min("__i").alias("__i"))
    return first.select(key, "match_url", (F.row_number().over(W.partitionBy(key).orderBy("__i")) - 1).alias("nth"))


def read_eras(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, until, map_pool) from a JSON file of eras; gaps, overlaps and empty pools fail."""
    schema = Ty.StructType.fromDDL("region STRING, active_era STRING, eras ARRAY<STRUCT<name: STRING, start: STRING, `end`: STRING, map_pool: ARRAY<STRING>>>, event_urls ARRAY<STRING>")
    eras = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("eras"))
    eras = eras.select("name", F.to_date("start").alias("start"), F.to_date("end").alias("until"), F.array_distinct(F.transform("map_pool", names.map_name)).alias("map_pool"))
    return checked_eras(eras)


def checked_eras(eras: DataFrame) -> DataFrame:
    """``eras``, with a failing job where they do not follow one another or a pool is empty."""
    before = F.lag("until").over(W.orderBy("start"))
    first = F.row_number().over(W.orderBy("start")) == 1
    ok = F.when(first, F.lit(True)).otherwise(before.isNotNull() & (before == F.col("start"))) & (F.size("map_pool") > 0) & (F.col("until").isNull() | (F.col("start") < F.col("until")))
    return eras.withColumn("name", F.when(F.coalesce(ok, F.lit(False)), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("era out of line: "), F.col("name"))).cast("string")))


def era_of(rows: DataFrame, eras: DataFrame, ts: str = "ts") -> DataFrame:
    """``rows`` with the name and pool of their era, null without one; eras are a handful of rows."""
    day = F.to_date(ts)
    e = eras.select(F.col("name").alias("era"), "start", "until", "map_pool")
    return rows.join(F.broadcast(e), (day >= F.col("start")) & (F.col("until").isNull() | (day < F.col("until"))), "left").drop("start", "until")


FIXTURES = "fixtures ARRAY<STRUCT<match_id: STRING, event: STRING, scheduled_at: STRING, best_of: STRING, team_a_id: STRING, team_b_id: STRING>>"


def judge_fixtures(rows: DataFrame, as_of: str, eras: DataFrame | None = None, teams: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``ts``, ``length`` (the number in best_of) and ``reason``: why a fixture is left out, or null.

    All six texts must be there and not blank, teams must differ and be known
    (``teams``: team_id), times are without a zone and from ``as_of`` on,
    lengths have a veto script, the day lies in an era, and of several fixtures
    with one id all are left out.
    """
    fields = ["match_id", "event", "scheduled_at", "best_of", "team_a_id", "team_b_id"]
    blank = F.lit(False)
    for c in fields:
        blank = blank | F.coalesce(F.trim(c) == "", F.lit(True))
    zone = F.col("scheduled_at").rlike(r"(?i)(z|[+-]\d\d:?\d\d)\s*$") & F.col("scheduled_at").contains(":")
    out = rows.withColumn("ts", F.try_to_timestamp("scheduled_at").cast("timestamp_ntz")).withColumn("length", names.best_of(F.col("best_of")))
    counts = rows.where("match_id is not null").groupBy(F.col("match_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    out = out.join(counts, F.col("match_id") == F.col("__id"), "left")
    if eras is not None:
        out = era_of(out, eras)
    known = F.lit(True)
    if teams is not None:
        for side in ("a", "b"):
            ids = teams.select(F.col("team_id").alias(f"__{side}")).distinct()
            out = out.join(ids, F.col(f"team_{side}_id") == F.col(f"__{side}"), "left")
            known = known & F.col(f"__{side}").isNotNull()
    reason = (
        F.when(blank, "a field is missing")
        .when(F.col("team_a_id") == F.col("team_b_id"), "a team plays itself")
        .when(~known, "unknown team")
        .when(F.col("ts").isNull() | zone, "no time without a zone")
        .when(F.col("length").isNull() | ~F.col("length").isin(*SCRIPTS), "no series of that length")
        .when(F.col("__n") > 1, "the id is there twice")
        .when(F.col("ts") < F.to_timestamp_ntz(F.lit(as_of)), "past")
    )
    if eras is not None:
        reason = reason.when(F.col("era").isNull(), "no era")
    return out.withColumn("reason", reason).select(*rows.columns, "ts", "length", "reason")


def read_fixtures(spark: SparkSession, path: str, as_of: str, eras: DataFrame | None = None, teams: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(coming fixtures, those left out with a reason) from a JSON file; see :func:`judge_fixtures`."""
    rows = spark.read.schema(FIXTURES).json(path, multiLine=True).select(F.inline("fixtures"))
    judged = judge_fixtures(rows, as_of, eras, teams)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def sanity_report(matches: DataFrame, maps: DataFrame) -> DataFrame:
    """(measure, value): counts of matches and maps, the share of maps beyond regulation, and matches by format, unknown ones too."""
    m = maps.where("winner is not null").agg(F.count(F.lit(1)).alias("n"), F.avg(above_regulation(F.col("team1_score"), F.col("team2_score")).cast("double")).alias("ot"))
    cells = [F.struct(F.lit("maps").alias("measure"), F.col("n").cast("double").alias("value")), F.struct(F.lit("overtime_rate").alias("measure"), F.col("ot").alias("value"))]
    formats = matches.groupBy(F.coalesce("best_of", F.lit("unknown")).alias("format")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    total = matches.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("matches").alias("measure"), "value")
    return m.select(F.inline(F.array(*cells))).unionByName(total).unionByName(formats.select(F.concat(F.lit("format_"), "format").alias("measure"), "value"))


def quarantine_illegal(maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal maps, illegal ones with a reason)."""
    judged = legality(maps)
    return judged.where("illegal is null").drop("illegal"), judged.where("illegal is not null")
