"""HTML as nested rows: tags in document order, the elements that they open and close, their texts and tables.

A page is cut into tokens by one pattern. One pass over its tokens keeps the
open elements as a stack and notes, for each token, in which element it stands
and which elements end there. So elements know their place, parent, depth and
end, and whatever lies between an element's place and its end is inside it:
selections are filters over arrays of a row, and nothing is shuffled or sent to
Python.

Markup may be odd or cut off. An end tag closes the nearest open element of its
name and all that are open inside that; one without such an element is passed
over. Items, cells and paragraphs end where the next of their kind begins right
inside them, and so does a row, with its last cell. What is open at the end of the page ends there; a tag that
the end cuts off is no tag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Elements without content; those whose content is no markup; those that end where the next of their kind begins, by that.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")
IMPLIED = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "li": ("li",), "option": ("option",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
#: Elements that may be open at once; what is opened beyond has no content of its own.
MAX_DEPTH = 512
#: Tokens that are gathered in one array before it is put away: appending to an array copies it.
CHUNK = 256

_RAW = "|".join(RAW)
#: One token: a comment, an element whose content is no markup, a declaration, a tag (quoted values may hold its end), text.
TOKEN = (
    rf"(?is)<!--.*?(?:-->|\z)|<(?:{_RAW})\b[^>]*>.*?(?:</(?:{_RAW})\s*>|\z)|<[!?][^>]*(?:>|\z)"
    r"""|</?[a-z](?:[^>"']{possessive}|"[^"]*"|'[^']*')*{possessive_group}>|</?[a-z][^>]*(?:>|\z)|[^<]+|<"""
)
JAVA_TOKEN = TOKEN.replace("{possessive}", "++").replace("{possessive_group}", "+")
#: The same for engines that never go back over what they have read.
PLAIN_TOKEN = TOKEN.replace("{possessive}", "+").replace("{possessive_group}", "")

_KIND = "struct<kind:string,name:string,i:int>"
_OUT = "array<struct<parent:int,depth:int,ended:array<int>>>"
_STACK = "array<struct<name:string,id:int>>"
_ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, and written once into the plan, however often it is used."""
    return F.transform(F.array(value), use)[0]


def tokens(html: Column) -> Column:
    """ARRAY<STRING> of a page's tokens; null for a null page. Put together they are the page."""
    return F.regexp_extract_all(html, F.lit(JAVA_TOKEN), F.lit(0))


def _kind(token: Column) -> tuple[Column, Column]:
    """(open, void, close, text or other; the element's name in lower case)."""
    name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))
    whole = token.endswith(">") | name.isin(*RAW)
    kind = (
        F.when((token == "<") | ~token.startswith("<"), "text")
        .when((name == "") | ~whole, "other")
        .when(token.startswith("</"), "close")
        .when(name.isin(*VOID, *RAW), "void")
        .otherwise("open")
    )
    return kind, name


def is_text(token: Column) -> Column:
    return (token == "<") | ~token.startswith("<")


def _fold(t: Column) -> Column:
    """Struct of ``out`` (by token: parent, depth, ended) and the ``stack`` of what is open at the end."""

    def kinds(chunk: Column) -> Column:
        def one(x: Column) -> Column:
            kind, name = _kind(x["t"])
            return F.struct(kind.alias("kind"), name.alias("name"), x["i"].alias("i"))

        return F.transform(chunk, one)

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc["stack"], lambda s: s["name"]), x["name"]).cast("int")
        top, second = (F.try_element_at(acc["stack"], F.lit(k))["name"] for k in (1, 2))
        implied = F.lit(0)
        for name, ends in IMPLIED.items():
            both = F.when(top.isin("td", "th") & (second == "tr"), F.lit(2)).otherwise(F.lit(1)) if name == "tr" else F.lit(1)
            implied = F.when((x["name"] == name) & top.isin(*ends), both).otherwise(implied)
        ended = F.when(x["kind"] == "close", at).when(x["kind"] == "open", implied).otherwise(F.lit(0))

        def after(n: Column) -> Column:
            def put(left: Column) -> Column:
                pushed = (x["kind"] == "open") & (F.size(left) < MAX_DEPTH)
                empty = (x["kind"] == "void") | ((x["kind"] == "open") & ~pushed)
                own = F.transform(F.slice(acc["stack"], F.lit(1), n), lambda s: s["id"])
                note = F.struct(
                    F.coalesce(F.try_element_at(left, F.lit(1))["id"], F.lit(-1)).alias("parent"), F.size(left).alias("depth"), F.when(empty, F.concat(own, F.array(x["i"]))).otherwise(own).alias("ended")
                )
                stack = F.when(pushed, F.concat(F.array(F.struct(x["name"].alias("name"), x["i"].alias("id"))), left)).otherwise(left)
                return F.struct(stack.cast(_STACK).alias("stack"), F.concat(acc["out"], F.array(note).cast(_OUT)).alias("out"))

            return let(F.slice(acc["stack"], n + 1, F.lit(MAX_DEPTH)), put)

        return let(ended, after)

    none = F.array().cast(_OUT)
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(f"array<{_OUT}>").alias("out"))
    numbered = F.transform(t, lambda x, i: F.struct(x.alias("t"), i.cast("int").alias("i")))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(t) / CHUNK).cast("int") - 1, F.lit(0))), lambda k: F.slice(numbered, k * CHUNK + 1, F.lit(CHUNK)))

    def by_chunk(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(kinds(chunk), F.struct(acc["stack"].alias("stack"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["stack"].alias("stack"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return F.aggregate(chunks, start, by_chunk, lambda acc: F.struct(F.flatten(acc["out"]).alias("out"), acc["stack"].alias("stack")))


def attributes(tag: Column) -> Column:
    """MAP<STRING, STRING> of a tag's attributes by lower-case name; of several of a name, the first. Values may be quoted or not, or missing (empty)."""
    each = r"""(?is)[^\s"'=/>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
    parts = F.regexp_extract_all(F.regexp_replace(tag, r"(?s)^</?[^\s/>]+|>$", ""), F.lit(each), F.lit(0))

    def entry(p: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(p, r"""(?s)^[^\s=]+\s*=\s*(.*)$""", 1), r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.struct(F.lower(F.regexp_extract(p, r"(?s)^([^\s=]+)", 1)).alias("name"), unescaped(value).alias("value"))

    def once(entries: Column) -> Column:
        return F.map_from_entries(let(F.transform(entries, lambda x: x["name"]), lambda names: F.filter(entries, lambda x, k: F.array_position(names, x["name"]) == k + 1)))

    return let(F.transform(parts, entry), once)


def unescaped(text: Column) -> Column:
    """The common named and numbered characters of markup as themselves."""
    for mark, sign in _ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``tokens``, ``texts`` and ``elements``: structs of i, end, parent, depth, name, classes and attrs, in document order.

    ``i`` is the place of the element's tag among the tokens, from 0; what lies
    between i and ``end`` is inside it. ``parent`` is -1 at the top. ``texts`` has,
    in the place of each token, its text without white space around it, null
    for what is no text. A null page has null tokens and no elements; an empty
    one has none of either.
    """
    rows = pages.withColumn("tokens", tokens(F.col(html)))
    rows = rows.withColumn("texts", F.transform("tokens", lambda t: F.when(is_text(t), unescaped(F.regexp_replace(t, r"^\s+|\s+$", "")))))
    rows = rows.withColumn("__fold", F.when(F.size("tokens") > 0, _fold(F.col("tokens"))))
    notes = F.col("__fold.out")
    ended = F.flatten(F.transform(notes, lambda x, j: F.transform(x["ended"], lambda i: F.struct(i.alias("i"), j.cast("int").alias("end")))))
    rest = F.transform(F.col("__fold.stack"), lambda s: F.struct(s["id"].alias("i"), F.size("tokens").alias("end")))
    ends = F.array_sort(F.concat(ended, rest))

    def element(e: Column) -> Column:
        def made(tag: Column, note: Column, attrs: Column) -> Column:
            classes = F.filter(F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), r"\s+"), lambda c: c != "")
            return F.struct(e["i"].alias("i"), e["end"].alias("end"), note["parent"].alias("parent"), note["depth"].alias("depth"), _kind(tag)[1].alias("name"), classes.alias("classes"), attrs.alias("attrs"))

        return let(F.element_at("tokens", e["i"] + 1), lambda tag: let(F.element_at(notes, e["i"] + 1), lambda note: let(attributes(tag), lambda attrs: made(tag, note, attrs))))

    kind = "array<struct<i:int,end:int,parent:int,depth:int,name:string,classes:array<string>,attrs:map<string,string>>>"
    made = F.coalesce(F.transform(ends, element), F.array().cast(kind)).cast(kind)
    # Made whole behind a generator: else each field that is asked for would fold the tokens once more.
    rows = rows.select("*", F.explode_outer(F.array(F.struct(made.alias("elements"), F.lit(0).alias("one")))).alias("__made"))
    return rows.select("*", F.coalesce("__made.elements", F.array().cast(kind)).alias("elements")).drop("__fold", "__made")


def elements(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, i, end, parent, depth, name, classes, attrs, text): one row for each element of every page."""
    parsed = with_elements(pages.select(key, html), html)
    rows = parsed.select(key, "texts", F.explode("elements").alias("e"))
    return rows.select(key, "e.*", text(F.col("texts"), F.col("e")).alias("text"))


def inside(all_: Column, e: Column) -> Column:
    """The elements inside ``e``, in document order; null without an element."""
    return let(e, lambda y: F.when(y.isNotNull(), F.filter(all_, lambda x: (x["i"] > y["i"]) & (x["i"] < y["end"]))))


def of_class(some: Column, *classes: str) -> Column:
    """Those of ``some`` elements that have all the classes."""
    return F.filter(some, lambda x: F.array_size(F.array_intersect(x["classes"], F.array(*[F.lit(c) for c in classes]))) == len(classes))


def named(some: Column, name: str) -> Column:
    return F.filter(some, lambda x: x["name"] == name)


def under(some: Column, above: Column) -> Column:
    """Those of ``some`` elements that lie inside one of ``above``."""
    return let(above, lambda a: F.filter(some, lambda x: F.exists(a, lambda y: (x["i"] > y["i"]) & (x["i"] < y["end"]))))


def around(some: Column, e: Column) -> Column:
    """The nearest of ``some`` elements that ``e`` lies inside: the last of them to begin; null without one."""
    return let(e, lambda y: F.try_element_at(F.filter(some, lambda x: (x["i"] < y["i"]) & (y["i"] < x["end"])), F.lit(-1)))


def nth(some: Column, n: int) -> Column:
    """One of ``some`` elements, from 1, or -1 for the last; null if there are fewer."""
    return F.try_element_at(some, F.lit(n))


def text(texts: Column, e: Column) -> Column:
    """The texts inside an element, one after another; empty without an element."""
    return F.coalesce(let(e, lambda x: F.array_join(F.slice(texts, x["i"] + 2, F.greatest(x["end"] - x["i"] - 1, F.lit(0))), "")), F.lit(""))


def own_text(texts: Column, all_: Column, e: Column) -> Column:
    """The first text that stands right in an element, not in one inside it; null without one."""

    def found(x: Column, children: Column) -> Column:
        places = F.sequence(x["i"] + 1, F.greatest(x["end"] - 1, x["i"] + 1))
        here = F.filter(places, lambda k: (k < x["end"]) & F.element_at(texts, k + 1).isNotNull() & ~F.exists(children, lambda c: (c["i"] < k) & (k < c["end"])))
        return F.try_element_at(texts, nth(here, 1) + 1)

    return let(e, lambda x: F.when(x.isNotNull(), let(inside(all_, x), lambda children: found(x, children))))


def table_cells(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, table_nth, row_nth, cell_nth, header, text): the cells of every table, a cell belonging to the nearest table and row around it.

    Cells outside a row or a table are left out.
    """
    nested = with_elements(pages.select(key, html), html).select(key, "texts", "elements")
    cells = nested.select(key, "texts", "elements", F.explode(F.filter("elements", lambda x: x["name"].isin("td", "th"))).alias("c"))

    placed = cells.select(key, F.col("c.i").alias("i"), (F.col("c.name") == "th").alias("header"), text(F.col("texts"), F.col("c")).alias("text"), around(named(F.col("elements"), "tr"), F.col("c"))["i"].alias("row"), around(named(F.col("elements"), "table"), F.col("c"))["i"].alias("table"))
    placed = placed.where("row > table")
    return placed.select(
        key,
        (F.dense_rank().over(W.partitionBy(key).orderBy("table")) - 1).alias("table_nth"),
        (F.dense_rank().over(W.partitionBy(key, "table").orderBy("row")) - 1).alias("row_nth"),
        (F.row_number().over(W.partitionBy(key, "table", "row").orderBy("i")) - 1).alias("cell_nth"),
        "header", "text",
    )
