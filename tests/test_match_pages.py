"""Match pages: a whole one, its halves and players, the placeholders of a coming one, and pages that contradict themselves."""

import pytest

from oddsloom.sources import documents, match_pages

STATS = ("rating2", "acs", "kills", "deaths", "assists", "adr", "kast", "hsp", "fb", "fd")


def player(name, values, agents=("Jett",)):
    cells = "".join(f'<div class="ovw-stat" data-col="{c}"><span class="side mod-t">9</span><span class="side mod-both"> {v} </span></div>' for c, v in zip(STATS, values, strict=True))
    pictures = "".join(f'<img alt="{a}" src="/x.png">' for a in agents)
    return f'<div class="ovw-row"><div class="ovw-player"><span class="ovw-player-name">{name}</span></div><div class="ovw-agents">{pictures}</div>{cells}</div>'


def halves(rounds):
    return " / ".join(f'<span class="mod-{side}">{n}</span>' for side, n in rounds)


GOOD = ("1.21", 233, 18, 11, 4, "151.5", "81%", "33%", 3, "-")


def a_map(name="Haven", scores=(13, 7), winner=1, one=(("t", 8), ("ct", 5)), two=(("ct", 4), ("t", 3)), tables=2, label="<span class='mod-1'>PICK</span>", players=None, duration="48:12"):
    marks = ["score mod-win" if winner == k else "score" for k in (1, 2)]
    rows = players or [[player(f"p{t}{i}", GOOD, ("Jett", "Sova") if i else ("Omen",)) for i in range(2)] for t in range(2)]
    made = "".join(f'<div class="ovw-table"><div class="ovw-row mod-head"><span>Name</span></div>{"".join(r)}</div>' for r in rows[:tables])
    return f"""<div class="vm-stats-game" data-game-id="1"><div class="vm-stats-game-header">
      <div class="team"><div class="{marks[0]}"> {scores[0]} </div><span class="rank">1</span>{halves(one)}</div>
      <div class="map"><div style="a>b"><span> {name} {label}</span></div><div class="map-duration"> {duration}</div></div>
      <div class="team mod-right"><div class="{marks[1]}">{scores[1]}</div>{halves(two)}</div></div>{made}</div>"""


def page(maps, note="AAA ban Haven; BBB pick Split; Lotus remains;", winner=True, teams=("Team &amp; A", "B"), header="match-header", event="<div><div>Cup: Stage 2</div> x</div>", status="final", best="Bo3"):
    links = "".join(f'<a class="match-header-link wf-link-hover mod-{i + 1}" href="/team/{70 + i}/slug"><div class="wf-title-med">{t}</div></a>' for i, t in enumerate(teams))
    score = f'<div class="match-header-vs-score"><div class="match-header-vs-note">{status}</div><div class="sp-hide"><span class="{"match-header-vs-score-winner" if winner else "x"}">2</span><span>:</span><span>1</span></div><div class="match-header-vs-note">{best}</div></div>'
    return f"""<!DOCTYPE html><html><body><script>var a = '<div class="match-header">';</script><div class="wf-card {header}">
    <a class="match-header-event" href="/event/1/the-cup">{event}</a><div class="match-header-date"><div class="moment" data-utc-ts="2026-07-15 11:00:00">x</div></div>{links}{score}
    <div class="match-header-note">{note}</div></div><div class="vm-stats-game" data-game-id="all"><p>All maps</div>{"".join(maps)}</body></html>"""


def parsed(spark, pages):
    df = spark.createDataFrame([(f"https://x.example/{i + 500}/slug?y=1" if u is None else u, h) for i, (u, h) in enumerate(pages)], "url string, html string")
    return match_pages.parse_pages(df)


def test_a_whole_page(spark):
    over = a_map("Split", (12, 14), 2, (("ct", 6), ("t", 6), ("ot", 0)), (("t", 6), ("ct", 6), ("ot", 2)), label="")
    good, aside = parsed(spark, [(None, page([a_map(), over, a_map("TBD", (0, 0), 0, tables=0)]))])
    assert aside.count() == 0
    m = good.first().m
    assert (m.match_id, m.event_name, m.date, m.status, m.best_of, m.team1_score, m.team2_score) == ("500", "Cup: Stage 2", "2026-07-15T11:00:00", "completed", "Bo3", 2, 1)
    assert (m.team1.name, m.team1.team_id, m.team2.name, m.team2.team_id) == ("Team & A", "70", "B", "71")
    assert [(v.step_index, v.team, v.action, v.map_name) for v in m.veto_actions] == [(0, "AAA", "ban", "Haven"), (1, "BBB", "pick", "Split"), (2, None, "decider", "Lotus")]
    one, two = m.maps
    assert (one.map_name, one.team1_score, one.team2_score, one.winner, one.duration) == ("Haven", 13, 7, "Team & A", "48:12")
    assert (one.team1_first_half_rounds, one.team1_second_half_rounds, one.team1_atk_rounds, one.team1_def_rounds) == (8, 5, 8, 5)
    assert (one.team2_first_half_rounds, one.team2_second_half_rounds, one.team2_atk_rounds, one.team2_def_rounds) == (4, 3, 3, 4)
    assert (two.map_name, two.winner, two.team1_atk_rounds, two.team2_def_rounds) == ("Split", "B", 6, 6)
    assert len(one.player_stats) == 4 and [p.team_name for p in one.player_stats] == ["Team & A"] * 2 + ["B"] * 2
    p = one.player_stats[1]
    assert (p.player_name, p.rating, p.acs, p.kills, p.kast, p.hs_pct, p.first_kills, p.first_deaths, p.agents) == ("p01", 1.21, 233.0, 18, 81.0, 33.0, 3, None, ["Jett", "Sova"])
    assert one.agent_picks == {"Team & A": ["Omen", "Jett"], "B": ["Omen", "Jett"]}
    flat = documents.flatten_maps(good).collect()
    assert [(r.match_id, r.map_index, r.map_name, r.winner) for r in flat] == [("500", 0, "Haven", "Team & A"), ("500", 1, "Split", "B")]
    assert documents.flatten_players(good).count() == 8 and documents.flatten_vetoes(good).count() == 3 and documents.flatten_matches(good).first().team1_id == "70"


def test_halves_and_winners_that_are_not_there(spark):
    live = a_map(scores=(6, "-"), winner=1, one=(("t", 4), ("ct", "-")), two=(("", 1), ("", 2)), tables=0)
    good, aside = parsed(spark, [(None, page([live], note="", winner=False, status="LIVE now", event="", best="x")), (None, page([], winner=False, status="2h 3m", note="a strange note"))])
    assert aside.count() == 0
    a, b = (r.m for r in good.orderBy("url").collect())
    assert (a.status, a.event_name, a.best_of, a.veto_actions) == ("live", "the cup", None, []) and (b.status, b.maps, b.veto_actions) == ("upcoming", [], [])
    x = a.maps[0]
    assert (x.winner, x.team2_score, x.team1_first_half_rounds, x.team1_second_half_rounds, x.team1_atk_rounds, x.team1_def_rounds) == (None, None, 4, None, 4, None)
    assert (x.team2_first_half_rounds, x.team2_atk_rounds, x.player_stats, x.agent_picks) == (None, None, [], None)


@pytest.mark.parametrize(
    ("made", "why"),
    [
        (lambda: (None, None), "no match page"),
        (lambda: (None, "<html><body>no"), "no match page"),
        (lambda: ("/event/12/slug", page([])), "no match number in its address"),
        (lambda: ("/about", page([])), "no match number in its address"),
        (lambda: (None, page([], teams=("only",))), "without two teams"),
        (lambda: (None, page([], teams=("A", " "))), "without two teams"),
        (lambda: (None, page([], event="").replace("/event/1/the-cup", "")), "no event"),
        (lambda: (None, page([a_map(" ", label="")])), "a map without a name"),
        (lambda: (None, page([a_map(tables=1)])), "a map with the players of one team"),
        (lambda: (None, page([a_map(players=[[player(" ", GOOD)], [player("b", GOOD)]])])), "a player without a name"),
        (lambda: (None, page([a_map(winner=2)])), "a winner against the score"),
        (lambda: (None, page([a_map(scores=(12, 7))])), "illegal score"),
        (lambda: (None, page([a_map(scores=(15, 12))])), "illegal score"),
        (lambda: (None, page([a_map(one=(("t", 9), ("ct", 5)))])), "a first half of another length"),
        (lambda: (None, page([a_map(one=(("t", 8), ("ct", 12)))])), "a second half that is too long"),
    ],
)
def test_pages_that_are_set_aside(spark, made, why):
    good, aside = parsed(spark, [made()])
    assert good.count() == 0 and aside.first().reason == why


def test_a_page_that_is_cut_off(spark):
    whole = page([a_map(), a_map("Split")])
    good, aside = parsed(spark, [(None, whole[: int(len(whole) * part / 20)]) for part in range(21)])
    assert good.count() + aside.count() == 21 and good.count() >= 1
    assert {r.reason for r in aside.collect()} <= {"no match page", "no event", "without two teams", "a map without a name", "a map with the players of one team", "a player without a name"}
