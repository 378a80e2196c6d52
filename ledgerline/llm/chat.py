"""Chat formatting with one training example for every assistant turn.

A conversation is rendered once as a stream of marked turns. Each assistant turn
gives one example: the stream up to that turn's end, with the reply alone under
the loss mask. Turns after the last reply (or of a conversation without one) are
kept by one more row without a target, so that nothing is lost and every
conversation can be read back from its last row.

Template, a line for each turn (a text may hold line ends itself):

    <<SYS>> text <</SYS>>       system
    [INST] text [/INST]         user
    <s> text </s>               assistant
    <<ROLE>> hex text <</ROLE>> any other role, its name in hexadecimal

Control strings inside texts get a backslash before them, one more than they have
already; a marker of the template never follows one, for a space or a line end
stands between. Taking one backslash away restores the text.

An example holds all preceding turns by definition, so one conversation is
gathered in one row; conversations are dealt over tasks, never put together.

Defined results: null texts and roles are empty; turns are ordered by turn (null
first), then role, then text; repeated rows are turns of their own; a null
conv_id is one conversation; an empty table gives no examples; extra columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The control strings, and the opening and closing of each role.
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<<ROLE>>", "<</ROLE>>", "<s>", "</s>")
TEMPLATE = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("<<ROLE>> ", " <</ROLE>>\n")
TRAINED = "assistant"

_ANY = "(" + "|".join(re.escape(c) for c in CONTROL) + ")"
_OPENS = "|".join(re.escape(o) for o, _ in (*TEMPLATE.values(), OTHER))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ANY, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _ANY, "$1")


def _by_role(role: Column, known: dict[str, Column], other: Column) -> Column:
    out = None
    for name, value in known.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn, and one for turns after the last.

    conv_id, example (place of its last turn, from 1), text, loss_start and
    loss_end (code points; equal where nothing is trained), is_last.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = escape(text)
    opening = _by_role(role, {r: F.lit(o) for r, (o, _) in TEMPLATE.items()}, F.concat(F.lit(OTHER[0]), F.hex(F.encode(role, "UTF-8")), F.lit(" ")))
    closing = _by_role(role, {r: F.lit(c) for r, (_, c) in TEMPLATE.items()}, F.lit(OTHER[1]))
    rendered = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(opening, body, closing).alias("rendered"), F.length(body).alias("size"), F.length(closing).alias("closing"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rendered.select("conv_id", F.row_number().over(order).alias("n"), (F.col("role") == TRAINED).alias("trained"), F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"), "size", "closing", "rendered")
    # The window and the aggregation share one shuffle by conversation.
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "trained", "end", "size", "closing", "rendered"))).alias("turns"))
    stream = F.array_join(F.transform("turns", lambda t: t["rendered"]), "")
    marks = F.transform(F.filter("turns", lambda t: t["trained"] | (t["n"] == F.size("turns"))), lambda t: F.struct(t["n"], t["trained"], t["end"], t["size"], t["closing"]))
    exploded = whole.select("conv_id", stream.alias("stream"), F.size("turns").alias("count"), F.explode(marks).alias("t"))
    end = F.col("t.end").cast("int")
    loss_end = F.when(F.col("t.trained"), end - F.col("t.closing")).otherwise(end)
    return exploded.select(
        "conv_id",
        F.col("t.n").alias("example"),
        F.substring("stream", F.lit(1), end).alias("text"),
        F.when(F.col("t.trained"), loss_end - F.col("t.size")).otherwise(end).alias("loss_start"),
        loss_end.alias("loss_end"),
        (F.col("t.n") == F.col("count")).alias("is_last"),
    )


def parse(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.split(text, rf"(?<!\\)(?={_OPENS})", -1)

    def inside(piece: Column, opening: str, closing: str) -> Column:
        return piece.substr(F.lit(len(opening) + 1), F.length(piece) - F.lit(len(opening) + len(closing)))

    def turn(piece: Column) -> Column:
        found = None
        for role, (opening, closing) in TEMPLATE.items():
            value = F.struct(F.lit(role).alias("role"), unescape(inside(piece, opening, closing)).alias("text"))
            found = F.when(piece.startswith(opening), value) if found is None else found.when(piece.startswith(opening), value)
        other = inside(piece, *OTHER)
        at = F.instr(other, " ")
        name = F.decode(F.unhex(F.substring(other, F.lit(1), at - 1)), "UTF-8")
        return found.otherwise(F.struct(name.alias("role"), unescape(F.substring(other, at + 1, F.length(other))).alias("text")))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation's examples say, read back from their texts and masks."""
    turns = parse(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("reply"),
        F.when(F.col("is_last"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(said, 256).alias("sha"))).alias("whole"),
    )
    joined = read.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "").alias("loss"), F.count("*").alias("n_examples"))
    return joined.select("conv_id", F.col("whole.n").alias("n_turns"), F.col("whole.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like the template."""
    return spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
