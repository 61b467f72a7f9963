"""Match pages as nested documents: header, maps, halves, players and the veto, cut out of markup with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions import names
from oddsloom.sources import markup as M
from oddsloom.sources.documents import MAP, MATCH, PLAYER, VETO

#: A player's numbers by the column that holds them, and whether they are whole.
STATS = {
    "rating": ("rating2", False), "acs": ("acs", False), "kills": ("kills", True), "deaths": ("deaths", True), "assists": ("assists", True), "adr": ("adr", False),
    "kast": ("kast", False), "hs_pct": ("hsp", False), "first_kills": ("fb", True), "first_deaths": ("fd", True),
}
#: A half of regulation has this many rounds.
HALF = 12
_ACTED, _REST = r"(?i)^(\S.*?)\s+(ban|pick)s?\s+(\S.*)$", r"(?i)^(\S.*?)\s+remains?$"


def veto_of(note: Column) -> Column:
    """The steps of a veto note, in order; empty for no note and for one with a part that is no step."""
    parts = F.filter(F.transform(F.split(F.coalesce(note, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def step(p: Column, i: Column) -> Column:
        action = F.lower(F.regexp_extract(p, _ACTED, 2))
        acts = action != ""
        return F.struct(
            i.cast("int").alias("step_index"), F.when(acts, F.regexp_extract(p, _ACTED, 1)).alias("team"), F.when(acts, action).otherwise("decider").alias("action"),
            F.when(acts, F.regexp_extract(p, _ACTED, 3)).otherwise(F.regexp_extract(p, _REST, 1)).alias("map_name"),
        )

    good = F.forall(parts, lambda p: p.rlike(_ACTED) | p.rlike(_REST))
    return F.when(good, F.transform(parts, step)).otherwise(F.array().cast(f"array<{VETO}>")).cast(f"array<{VETO}>")


def _players(page: Column, table: Column, own: Column, team: Column) -> Column:
    """One team's rows: ``own`` are the elements inside the map's block."""

    def player(cells: Column) -> Column:
        def total(c: Column) -> Column:
            both = M.nth(M.of_class(M.inside(cells, c), "side", "mod-both"), 1)
            return F.struct(F.element_at(c["attrs"], "data-col").alias("column"), M.let(both, lambda b: F.when(b.isNotNull(), M.text(page, b))).alias("value"))

        def made(values: Column) -> Column:
            def value(column: str) -> Column:
                return M.nth(F.filter(values, lambda v: v["column"] == column), -1)["value"]

            pictures = M.under(M.named(cells, "img"), M.of_class(cells, "ovw-agents"))
            agents = F.filter(F.transform(pictures, lambda x: F.try_element_at(x["attrs"], F.lit("alt"))), lambda a: F.coalesce(a != "", F.lit(False)))
            numbers = [(names.lenient_int if whole else names.lenient_float)(value(column)).alias(n) for n, (column, whole) in STATS.items()]
            return F.struct(F.nullif(M.text(page, M.nth(M.of_class(cells, "ovw-player-name"), 1)), F.lit("")).alias("player_name"), team.alias("team_name"), *numbers, agents.alias("agents")).cast(PLAYER)

        return M.let(F.transform(F.filter(cells, lambda x: F.map_contains_key(x["attrs"], "data-col")), total), made)

    rows = F.filter(M.inside(own, table), lambda x: F.array_contains(x["classes"], "ovw-row") & ~F.array_contains(x["classes"], "mod-head"))
    return F.coalesce(F.transform(rows, lambda row: M.let(M.inside(own, row), player)), F.array().cast(f"array<{PLAYER}>"))


def _halves(page: Column, header: Column, teams: Column) -> Column:
    """By team, the rounds by half and by side, from the spans that name a side; a span without a number counts as a half without one."""

    def rounds(team: Column) -> Column:
        spans = F.filter(M.named(M.inside(header, team), "span"), lambda x: F.arrays_overlap(x["classes"], F.array(F.lit("mod-t"), F.lit("mod-ct"))))
        return F.transform(spans, lambda x: F.struct(F.array_contains(x["classes"], "mod-t").alias("atk"), names.lenient_int(M.text(page, x)).alias("n")))

    def made(r: Column) -> Column:
        def added(atk: bool) -> Column:
            return M.let(F.filter(r, lambda x: (x["atk"] == F.lit(atk)) & x["n"].isNotNull()), lambda known: F.when(F.size(known) > 0, F.aggregate(known, F.lit(0), lambda a, x: a + x["n"])))

        return F.struct(M.nth(r, 1)["n"].alias("first_half"), M.nth(r, 2)["n"].alias("second_half"), added(True).alias("atk"), added(False).alias("def"))

    return F.transform(F.slice(teams, 1, 2), lambda team: M.let(rounds(team), made))


def _map(page: Column, all_: Column, game: Column, team1: Column, team2: Column) -> Column:
    """Struct of a map as documents have it (``x``) and why it cannot be one (``wrong``); null for a block without a header."""

    def parts(own: Column, header: Column) -> Column:
        teams, won = M.of_class(header, "team"), M.nth(M.of_class(header, "score", "mod-win"), 1)
        box = M.inside(header, M.nth(M.of_class(header, "map"), 1))
        name = M.let(box, lambda b: M.own_text(page, header, M.nth(M.under(M.named(b, "span"), M.named(b, "div")), 1)))
        spent = M.let(M.nth(M.of_class(header, "map-duration"), 1), lambda e: F.when(e.isNotNull(), M.text(page, e)))
        scores = F.transform(M.under(M.of_class(header, "score"), teams), lambda x: names.lenient_int(M.text(page, x)))
        return F.struct(
            F.coalesce(name, F.lit("")).alias("name"), scores.alias("scores"), M.let(won, lambda w: F.struct((w.isNotNull()).alias("known"), F.coalesce(F.array_contains(M.around(M.named(teams, "div"), w)["classes"], "mod-right"), F.lit(False)).alias("right"))).alias("won"),
            spent.alias("duration"), M.of_class(own, "ovw-table").alias("tables"), M.let(teams, lambda t: _halves(page, header, t)).alias("halves"),
        )

    def made(own: Column, b: Column, sides: Column) -> Column:
        a, c = M.nth(b["scores"], 1), M.nth(b["scores"], 2)
        winner = F.when(b["won"]["known"] & a.isNotNull() & c.isNotNull(), F.when(b["won"]["right"], team2).otherwise(team1))
        two = F.size(b["tables"]) == 2
        # The first agent of each player, in the order of the table.
        picks = F.transform(sides, lambda side: F.transform(side, lambda p: F.coalesce(F.try_element_at(p["agents"], F.lit(1)), F.lit(""))))
        rounds = [M.nth(b["halves"], k)[n].alias(f"team{k}_{n}_rounds") for k in (1, 2) for n in ("first_half", "second_half", "atk", "def")]
        return F.struct(
            b["name"].alias("map_name"), a.alias("team1_score"), c.alias("team2_score"), winner.alias("winner"), b["duration"].alias("duration"),
            F.when(two & (team1 != team2), F.map_from_arrays(F.array(team1, team2), picks)).alias("agent_picks"), F.when(two, F.flatten(sides)).otherwise(F.array().cast(f"array<{PLAYER}>")).alias("player_stats"), *rounds,
        ).cast(MAP)

    def judged(x: Column, tables: Column) -> Column:
        hi, lo = F.greatest(x["team1_score"], x["team2_score"]), F.least(x["team1_score"], x["team2_score"])
        finished = x["winner"].isNotNull()
        wrong = (
            F.when(x["map_name"] == "", "a map without a name")
            .when(~F.size(tables).isin(0, 2), "a map with the players of one team")
            .when(F.exists(x["player_stats"], lambda p: p["player_name"].isNull()), "a player without a name")
            .when(finished & (x["team1_score"] != x["team2_score"]) & (x["winner"] != F.when(x["team1_score"] > x["team2_score"], team1).otherwise(team2)), "a winner against the score")
            .when(finished & ((hi < 13) | ((lo >= HALF) & (hi - lo != 2)) | ((lo < HALF) & (hi != 13))), "illegal score")
            .when(finished & (x["team1_first_half_rounds"] + x["team2_first_half_rounds"] != HALF), "a first half of another length")
            .when(finished & (x["team1_second_half_rounds"] + x["team2_second_half_rounds"] > HALF), "a second half that is too long")
        )
        return F.struct(x.alias("x"), wrong.alias("wrong"))

    def with_header(own: Column, header: Column) -> Column:
        def with_parts(b: Column) -> Column:
            both = F.array(*[F.struct(M.nth(b["tables"], k).alias("table"), t.alias("team")) for k, t in ((1, team1), (2, team2))])
            return M.let(F.transform(both, lambda x: _players(page, x["table"], own, x["team"])), lambda s: M.let(made(own, b, s), lambda x: judged(x, b["tables"])))

        return M.let(parts(own, header), with_parts)

    def in_block(own: Column) -> Column:
        return M.let(M.inside(own, M.nth(M.of_class(own, "vm-stats-game-header"), 1)), lambda header: F.when(header.isNotNull(), with_header(own, header)))

    return M.let(M.inside(all_, game), in_block)


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(documents with a column ``m``, pages set aside with a reason) from match pages, as :func:`oddsloom.sources.documents.parse` gives them from JSON.

    Team 1 and its table come first on a page. Placeholders of maps to come
    (TBD) are left out; a note that is no veto gives none. A page without a
    header, an event, two named teams or a match's number in its address, or with
    a map that contradicts itself, is set aside; a null page too. A text that is
    no number or time is null.
    """
    rows = M.with_elements(pages.select(F.col(url).alias("url"), F.col(html).alias("html")), "html")
    page, head = F.col("texts"), F.col("head")
    rows = rows.withColumn("head", M.inside(F.col("elements"), M.nth(M.named(M.of_class(F.col("elements"), "match-header"), "div"), 1)))
    # Column by column, so that a selection is in the plan once.
    rows = rows.withColumns({
        "event": M.nth(M.of_class(head, "match-header-event"), 1), "links": M.of_class(head, "match-header-link"), "versus": M.of_class(head, "match-header-vs-score"),
        "stamp": M.nth(F.filter(M.under(head, M.of_class(head, "match-header-date")), lambda x: F.map_contains_key(x["attrs"], "data-utc-ts")), 1),
        "note": M.text(page, M.nth(M.of_class(head, "match-header-note"), 1)), "decided": F.size(M.of_class(head, "match-header-vs-score-winner")) > 0,
    })
    event, links, versus = F.col("event"), F.col("links"), F.col("versus")

    def team(k: int) -> Column:
        def one(link: Column) -> Column:
            number = F.regexp_extract(F.coalesce(F.try_element_at(link["attrs"], F.lit("href")), F.lit("")), r"/team/(\d+)", 1)
            return F.struct(M.text(page, M.nth(M.of_class(M.inside(head, link), "wf-title-med"), 1)).alias("name"), F.nullif(number, F.lit("")).alias("team_id"))

        return M.let(M.nth(links, k), one)

    def event_name(within: Column) -> Column:
        divs = M.named(F.concat(F.array(event), within), "div")
        nested = M.nth(M.let(divs, lambda d: F.filter(M.named(within, "div"), lambda x: F.exists(d, lambda y: y["i"] == x["parent"]))), 1)
        slug = F.replace(F.regexp_extract(F.coalesce(F.try_element_at(event["attrs"], F.lit("href")), F.lit("")), r"([^/]*)$", 1), F.lit("-"), F.lit(" "))
        return F.coalesce(F.nullif(M.text(page, nested), F.lit("")), slug)

    rows = rows.withColumns({
        "name": F.when(event.isNotNull(), M.let(M.inside(head, event), event_name)), "team1": team(1), "team2": team(2),
        "date": F.date_format(F.try_to_timestamp(F.trim(F.try_element_at(F.col("stamp")["attrs"], F.lit("data-utc-ts")))), "yyyy-MM-dd'T'HH:mm:ss"),
        "notes": F.transform(M.under(M.of_class(head, "match-header-vs-note"), versus), lambda x: M.text(page, x)),
        "digits": F.filter(F.transform(M.under(M.under(M.named(head, "span"), M.of_class(head, "sp-hide")), versus), lambda x: M.text(page, x)), lambda t: t.rlike(r"^\d+$")),
    })
    rows = rows.withColumns({"name1": F.col("team1.name"), "name2": F.col("team2.name")})
    parsed = F.transform(M.of_class(F.col("elements"), "vm-stats-game"), lambda g: _map(page, F.col("elements"), g, F.col("name1"), F.col("name2")))
    rows = rows.withColumn("maps", F.filter(parsed, lambda x: x.isNotNull() & ~F.coalesce(F.upper(F.trim(x["x"]["map_name"])) == "TBD", F.lit(False))))
    status = F.when(F.col("decided"), "completed").when(F.lower(M.nth(F.col("notes"), 1)).contains("live"), "live").otherwise("upcoming")
    number = F.when(~F.col("url").contains("/event/"), names.match_id_of(F.col("url")))
    m = F.struct(
        number.alias("match_id"), "url", F.col("name").alias("event_name"), "date", "team1", "team2", *[names.lenient_int(M.nth(F.col("digits"), k)).alias(f"team{k}_score") for k in (1, 2)],
        M.nth(F.filter("notes", lambda t: t.rlike(r"^Bo\d+$")), -1).alias("best_of"), F.transform("maps", lambda x: x["x"]).alias("maps"), veto_of(F.col("note")).alias("veto_actions"), status.alias("status"),
    ).cast(MATCH)
    reason = (
        F.when(head.isNull(), "no match page")
        .when(number.isNull(), "no match number in its address")
        .when(F.coalesce(F.col("name") == "", F.lit(True)), "no event")
        .when((F.size(links) < 2) | (F.col("name1") == "") | (F.col("name2") == ""), "without two teams")
        .otherwise(M.nth(F.filter(F.transform("maps", lambda x: x["wrong"]), lambda w: w.isNotNull()), 1))
    )
    # Filters do not pass a generator: pushed through the columns above, they would be written out once for each use.
    out = rows.select("url", "html", F.explode_outer(F.array(F.struct(m.alias("m"), reason.alias("reason")))).alias("d")).select("url", "html", "d.m", "d.reason")
    return out.where("reason is null").select("url", "m"), out.where("reason is not null").select("url", "html", "reason")
