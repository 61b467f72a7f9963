"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written as ``<s>[INST] role [/INST]text</s>``. What was written is
parsed again by one deterministic grammar and compared with the source; where
they differ, the turns at fault are written with their control strings escaped,
until the recovered turns are identical. The escape is the sign ``~``: it is
doubled, and one is put inside each control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: No role or text as written may hold one of these.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Double ``~`` and part every control string by one ``~``."""
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~~")), r"([<\[])(/?s>|/?INST\])", r"$1~$2")


def _holds_control(text: Column) -> Column:
    found = F.lit(False)
    for c in CONTROL:
        found = found | text.contains(c)
    return found


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`, reading from the left; it changes any text with a ``~``."""
    return F.when(text.contains("~"), F.regexp_replace(text, "~(~?)", "$1")).otherwise(text)


def frame(role: Column, text: Column) -> Column:
    """One turn as it is written."""
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, or null if it is not in the language.

    The whole string must be frames one after another: each ends at the next
    ``</s>``, begins with the opening, and its role ends at the first middle.
    No role or text may hold a control string.
    """
    ends = F.split(formatted, CLOSE)
    frames = F.slice(ends, F.lit(1), F.size(ends) - 1)

    def turn(f: Column) -> Column:
        middle = F.instr(f, MIDDLE)
        role = F.substring(f, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
        text = F.substring(f, middle + len(MIDDLE), F.char_length(f))
        return F.when(f.startswith(OPEN) & (middle > len(OPEN)), F.struct(role.alias("role"), text.alias("text")))

    raw = F.transform(frames, turn)
    legal = (F.element_at(ends, -1) == "") & ~F.exists(raw, lambda t: t.isNull() | _holds_control(t["role"]) | _holds_control(t["text"]))
    return F.when(legal, F.transform(raw, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def format_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key, ``formatted`` text, ``turns`` as parsed back and ``loss`` spans (start, length).

    Spans are in code points of ``formatted`` and cover the assistant's texts as
    written. A conversation is written plainly and parsed again. Where the
    grammar does not give its turns back, each turn is tried alone, those that
    do not come back are escaped, and the whole is parsed again; if it still did
    not come back, the job fails rather than return it.

    Turns stand in order of ``order``; ties, by role and text, as do rows
    without an order, which come first. Repeated rows are repeated turns; null
    roles and texts are empty; a null key is one conversation; an empty table
    gives an empty result. Other columns, of any name, are not looked at. A
    conversation has to fit into one row, as its text is one value; only its
    turns are gathered.
    """
    source = F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    whole = turns.select(F.col(key).alias("__key"), F.struct(F.col(order).alias("order"), source.alias("source")).alias("__turn")).groupBy("__key")
    out = whole.agg(F.array_sort(F.collect_list("__turn")).alias("__turns")).select("__key", F.transform("__turns", lambda t: t["source"]).alias("__sources"))

    def plain(t: Column) -> Column:
        return frame(t["role"], t["text"])

    def tried(t: Column) -> Column:
        return F.when(parse(plain(t)).eqNullSafe(F.array(t)), plain(t)).otherwise(frame(escape(t["role"]), escape(t["text"])))

    # Each step is a column that the next one reads, so that nothing is parsed twice.
    out = out.withColumn("__plain", F.transform("__sources", plain))
    out = out.withColumn("__first", F.array_join("__plain", "")).withColumn("__parsed", parse(F.col("__first")))
    out = out.withColumn("__ok", F.col("__parsed").eqNullSafe(F.col("__sources")))
    out = out.withColumn("__pieces", F.when(F.col("__ok"), F.col("__plain")).otherwise(F.transform("__sources", tried)))
    out = out.withColumn("formatted", F.when(F.col("__ok"), F.col("__first")).otherwise(F.array_join("__pieces", "")))
    out = out.withColumn("__back", F.when(F.col("__ok"), F.col("__parsed")).otherwise(parse(F.col("formatted"))))
    checked = F.when(F.col("__back").eqNullSafe(F.col("__sources")), F.col("__back")).otherwise(
        F.raise_error(F.lit("a conversation did not survive its round trip")).cast(TURNS)
    )
    spans = F.aggregate(
        F.arrays_zip(F.col("__pieces").alias("piece"), F.col("__sources").alias("source")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["piece"])).alias("at"),
            F.when(t["source"]["role"] == "assistant", F.concat(acc["spans"], F.array(_span(acc["at"], t["piece"])))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return out.select(F.col("__key").alias(key), "formatted", checked.alias("turns"), spans.alias("loss"))


def _span(at: Column, piece: Column) -> Column:
    """Where the text of a piece is that begins at ``at``."""
    before = F.instr(piece, MIDDLE) - 1 + len(MIDDLE)
    return F.struct((at + before).cast("long").alias("start"), (F.char_length(piece) - before - len(CLOSE)).cast("long").alias("length"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, read from the formatted string and unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations: counts and sha256 of turns and of text under the mask."""
    spoken = loss_text(F.col("formatted"), F.col("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("__loss", spoken).select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
