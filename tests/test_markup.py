"""Nested rows of markup against a plain stack parser, odd and cut-off pages included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from oddsloom.sources import markup


def plain_tokens(html):
    """By hand, one character at a time."""
    out, i = [], 0
    while i < len(html):
        low = html[i:].lower()
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            j = len(html) if end < 0 else end + 3
        elif m := re.match(r"<(script|style)\b[^>]*>", low):
            close = re.compile(r"</(?:script|style)\s*>", re.I).search(html, i + m.end())
            j = close.end() if close else len(html)
        elif re.match(r"<[!?]", low):
            end = html.find(">", i)
            j = len(html) if end < 0 else end + 1
        elif re.match(r"</?[a-z]", low):
            j, quote = i + 1, ""
            while j < len(html) and (quote or html[j] != ">"):
                if quote and html[j] == quote:
                    quote = ""
                elif not quote and html[j] in "\"'":
                    quote = html[j]
                j += 1
            if j == len(html):
                end = html.find(">", i)
                j = len(html) if end < 0 else end
            j = min(len(html), j + 1)
        elif html[i] == "<":
            j = i + 1
        else:
            end = html.find("<", i)
            j = len(html) if end < 0 else end
        out.append(html[i:j])
        i = j
    return out


def plain_elements(html):
    """[(i, end, parent, depth, name)] with an explicit stack."""
    stack, found = [], {}
    parts = plain_tokens(html)
    for i, t in enumerate(parts):
        m = re.match(r"</?([a-zA-Z][^\s/>]*)", t)
        if not m or t == "<":
            continue
        name = m[1].lower()
        if not t.endswith(">") and name not in markup.RAW:
            continue
        if t.startswith("</"):
            at = next((k for k in range(len(stack) - 1, -1, -1) if found[stack[k]][4] == name), None)
            if at is not None:
                for k in stack[at:]:
                    found[k][1] = i
                del stack[at:]
            continue
        for ends in [["td", "th"], ["tr"]] if name == "tr" else [markup.IMPLIED.get(name, [])]:
            if stack and found[stack[-1]][4] in ends:
                found[stack.pop()][1] = i
        found[i] = [i, i, stack[-1] if stack else -1, len(stack), name]
        if name not in (*markup.VOID, *markup.RAW) and len(stack) < markup.MAX_DEPTH:
            found[i][1] = len(parts)
            stack.append(i)
    return [tuple(found[i]) for i in sorted(found)]


def random_page(rng, n):
    parts = []
    for _ in range(n):
        name = rng.choice("div p li ul b span table tr td th dd dt br IMG a H1".split())
        kind = rng.random()
        if kind < 0.4:
            parts.append(f"<{name}{rng.choice(['', ' class=x', ' title=\"a > b\"', ' data-col=\"y\" class=\"p  q\"', ' /'])}>")
        elif kind < 0.7:
            parts.append(f"</{name}{rng.choice(['', ' '])}>")
        elif kind < 0.95:
            parts.append(rng.choice(["text", " ", "a < b", "&amp;x", "1 > 0", "\n"]))
        else:
            parts.append(rng.choice(["<!-- <p> -->", "<!DOCTYPE html>", "<script>if (a<b) '</p>'</script>", "<style>p{}</STYLE>", "<", "</>", "<a title='x>"]))
    return "".join(parts)


ODD = [
    "", "no markup", "<p>", "</p>", "<p><p><p>", "<b><i></b></i>", "<div", "<div><span", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<!-- open <p>", "<script>var x = '<p>'", "<a title=\"x>y</a>",
    "<table><tr><td>1<td>2<tr><td>3</table>", "<br/><br></br>", "<x-y a=1>z</X-Y>", "<p>" * 40 + "</div>" * 5, "<div>" * 30, "é<p>ü</p>🙂<b>", "<<p>>", "< p>",
]


def test_elements_are_those_of_a_stack_parser(spark):
    rng = random.Random(4)
    pages = [*ODD, *[random_page(rng, rng.randint(1, 60)) for _ in range(150)], random_page(rng, 1500)]
    pages += [p[: rng.randrange(len(p) + 1)] for p in pages]
    df = spark.createDataFrame([*[(i, p) for i, p in enumerate(pages)], (-1, None)], "page_id long, html string")
    got = {r.page_id: r for r in markup.with_elements(df).collect()}
    assert got[-1].tokens is None and got[-1].elements == []
    for i, p in enumerate(pages):
        assert "".join(got[i].tokens) == p
        assert got[i].tokens == plain_tokens(p), p
        assert [(e.i, e.end, e.parent, e.depth, e.name) for e in got[i].elements] == plain_elements(p), p


def test_more_open_elements_than_are_kept(spark):
    page = "<div>" * (markup.MAX_DEPTH + 20) + "x" + "</div>" * 3
    got = markup.with_elements(spark.createDataFrame([(1, page)], "page_id long, html string")).first().elements
    assert [(e.i, e.end, e.parent, e.depth, e.name) for e in got] == plain_elements(page)


def test_attributes_and_texts(spark):
    tags = {
        '<a href="/x?a=1&amp;b=2" class="p q">': ("/x?a=1&b=2", "p q"), "<a class='one' HREF=/y>": ("/y", "one"), '<a title="href=no class=no">': (None, None), "<a href>": ("", None),
        '<a class="first" class="second" href = "z" />': ("z", "first"), "<img\nhref='a>b'\nclass=c/>": ("a>b", "c/"),
    }
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    for r in df.select("t", markup.attributes(F.col("t")).alias("a")).collect():
        assert (r.a.get("href"), r.a.get("class")) == tags[r.t], r.t
    page = spark.createDataFrame([("u", "<div> a <b> x &amp; y </b>\n<i>z<br>w</i> <span class='k l'>one<em>two</em>three</span></div>tail")], "url string, html string")
    got = {r.name: r for r in markup.elements(page).collect()}
    assert got["b"].text == "x & y" and got["div"].text == "ax & yzwonetwothree" and got["br"].text == "" and got["span"].classes == ["k", "l"]
    whole = markup.with_elements(page)
    span = markup.nth(markup.of_class(F.col("elements"), "l", "k"), 1)
    assert whole.select(markup.own_text(F.col("texts"), F.col("elements"), span)).first()[0] == "one"


def test_tables_are_nested_rows(spark):
    page = "<table><tr><th>h<td>1<tr><td>2 <table><tr><td>in</table> more<td>3</table><td>out</td><table><tr><td>z"
    df = spark.createDataFrame([("u", page), ("v", None), ("w", "<p>")], "url string, html string")
    got = sorted((r.table_nth, r.row_nth, r.cell_nth, r.header, r.text) for r in markup.table_cells(df).collect())
    assert got == [(0, 0, 0, True, "h"), (0, 0, 1, False, "1"), (0, 1, 0, False, "2inmore"), (0, 1, 1, False, "3"), (1, 0, 0, False, "in"), (2, 0, 0, False, "z")]


def test_pages_need_no_python_and_no_shuffle(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = markup.elements(pages, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
