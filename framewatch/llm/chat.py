"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over roles validates the order of turns; every turn
becomes three text segments (open mark, text, close mark), each with a loss flag.
Control strings inside texts are escaped reversibly: backslashes are doubled,
then a backslash goes between the first and the second character of a control
string, so that a mark in the output always is one that the template put there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``marks``: role -> (open, close). ``other``: for any other role, (open, mark after the role's name, close)."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<TURN>>", "<<IS>>", "<</TURN>>")
    loss: tuple[str, ...] = ("assistant",)
    #: state -> {role -> next state}; a state is the role seen last.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        found = [m for pair in self.marks.values() for m in pair] + list(self.other)
        for a in found:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a mark needs two characters and no backslash: {a!r}")
            for b in found:
                if a != b and (a in b or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b))))):
                    raise ValueError(f"marks overlap: {a!r}, {b!r}")
        return found


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls():
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column, template: Template) -> Column:
    for mark in template.controls():
        text = F.replace(text, F.lit(mark[0] + "\\" + mark[1:]), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_turns(turns: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """One row per conversation: ``key``, n_turns, valid, formatted, segments (text, loss), loss_spans (start, length; code points).

    Turns go by ``turn``, then role, then text, so that ties and repeated rows
    have one order; null turns come first, a null role or text is empty. A
    conversation that breaks the order of roles is formatted as it stands, with
    valid false. Rows with a null key form one conversation. One conversation is
    one value, so it must fit a row (2 GB); nothing larger is gathered.
    """
    rows = turns.select(F.col(key), F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def opened(t: Column) -> Column:
        out = F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]))
        for role, (mark, _) in template.marks.items():
            out = F.when(t["role"] == role, F.lit(mark)).otherwise(out)
        return out

    def closed(t: Column) -> Column:
        out = F.lit(template.other[2])
        for role, (_, mark) in template.marks.items():
            out = F.when(t["role"] == role, F.lit(mark)).otherwise(out)
        return out

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(opened(t), F.lit(False)), piece(escape(t["text"], template), t["role"].isin(*template.loss)), piece(closed(t), F.lit(False)))

    def step(state: Column, t: Column) -> Column:
        bad = F.lit("bad")
        for was, roles in template.moves.items():
            bad = F.when((state == was) & t["role"].isin(*roles), t["role"]).otherwise(bad)
        return bad

    segments = grouped.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit("start"), step).isin(*template.ends).alias("valid"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
    )
    at = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def place(state: Column, s: Column) -> Column:
        size = F.char_length(s["text"]).cast("long")
        span = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct((state["at"] + size).alias("at"), F.when(s["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return segments.select(
        key, "n_turns", "valid",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.aggregate("segments", at, place, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, texts unescaped."""
    quote = lambda marks: "|".join(re.escape(m) for m in marks)
    closes = [c for _, c in template.marks.values()] + [template.other[2]]
    parts = F.filter(F.split(formatted, quote(closes)), lambda p: p != "")

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(template.other[0]) + 1))
        role = unescape(F.substring_index(rest, template.other[1], 1), template)
        text = F.substr(rest, F.char_length(F.substring_index(rest, template.other[1], 1)) + len(template.other[1]) + 1)
        for name, (mark, _) in template.marks.items():
            role = F.when(p.startswith(mark), F.lit(name)).otherwise(role)
            text = F.when(p.startswith(mark), F.substr(p, F.lit(len(mark) + 1))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(parts, turn)


def loss_texts(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, cut out of the formatted conversation and unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")), template))
