"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles says whether the turns of a conversation come in a permitted order. The template
gives each role an opening and a closing mark and says whether its text counts for the loss. A conversation becomes a list
of segments (text, loss), which joined are the formatted string. Marks inside a text are broken by an escape that reading
back removes, so the turns can be read from the string alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: the marks; ``other``: around any other role, whose name stands between ``name_open`` and ``name_close``.

    moves: state -> role -> state; a role without a move leads to no state. Texts end where a state is in ``accepts``.
    """

    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)})
    other: Role = Role("", "<<END>>")
    name_open: str = "<<ROLE>>"
    name_close: str = "<</ROLE>>"
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepts: tuple[str, ...] = ("answered",)

    @property
    def marks(self) -> list[str]:
        found = {m for r in (*self.roles.values(), self.other) for m in (r.open, r.close)} | {self.name_open, self.name_close}
        return sorted(found - {""}, key=lambda m: (-len(m), m))


LLAMA = Template()
STRETCH = 256


def escaped(text: Column, template: Template) -> Column:
    """A backslash becomes \\b; \\c goes behind the first character of each mark."""
    heads: dict[str, list[str]] = {}
    for m in template.marks:
        heads.setdefault(m[0], []).append(m[1:])
    pattern = "|".join(f"{re.escape(h)}(?={'|'.join(map(re.escape, rest))})" for h, rest in sorted(heads.items()))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), f"({pattern})", r"$1\\c")


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _by_role(role: Column, template: Template, value, other) -> Column:
    out = None
    for name, r in template.roles.items():
        out = F.when(role == name, value(r)) if out is None else out.when(role == name, value(r))
    return out.otherwise(other)


def formatted(conversations: DataFrame, template: Template = LLAMA) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn, segments, formatted, loss_spans), one row for each conv_id.

    Turns are ordered by turn (nulls first), then role and text; repeated rows are turns of their own. A null text or role is
    empty; rows with a null conv_id are one conversation. valid: the machine accepts the roles; bad_turn: the first turn
    (from 0) that has no move, null if there is none. loss_spans: (start, length) in characters of ``formatted``. One
    conversation is one value of the result, so its turns meet in one row. An empty table gives no rows.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def spoken(t: Column) -> Column:
        role = t["role"]
        named = F.concat(F.lit(template.name_open), escaped(role, template), F.lit(template.name_close), F.lit(template.other.open))
        loss = _by_role(role, template, lambda r: F.lit(r.loss), F.lit(template.other.loss))
        return F.array(
            F.struct(_by_role(role, template, lambda r: F.lit(r.open), named).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(_by_role(role, template, lambda r: F.lit(r.close), F.lit(template.other.close)).alias("text"), F.lit(False).alias("loss")),
        )

    moves = F.create_map(*(x for s, to in template.moves.items() for role, end in to.items() for x in (F.lit(f"{s}\n{role}"), F.lit(end))))
    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(s["state"], F.lit("\n"), t["role"]))
        return F.struct(F.when(s["bad"].isNull(), F.coalesce(to, F.lit(""))).otherwise(F.lit("")).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["bad"], F.when(to.isNull(), s["at"])).alias("bad"))

    told = talks.withColumn("segments", F.flatten(F.transform("turns", spoken))).withColumn("machine", F.aggregate("turns", zero, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def span(s: Column, g: Column) -> Column:
        n = F.length(g["text"])
        more = F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), n.alias("length"))))
        return F.struct((s["at"] + n).alias("at"), F.when(g["loss"], more).otherwise(s["spans"]).alias("spans"))

    def stretch(s: Column, some: Column) -> Column:
        begin = F.struct(s["at"].alias("at"), none["spans"].alias("spans"))
        return F.aggregate(some, begin, span, lambda r: F.struct(r["at"].alias("at"), F.concat(s["spans"], r["spans"]).alias("spans")))

    # spans are gathered a stretch at a time: each gathering copies what it has, so by single segments it would be quadratic
    stretches = F.transform(F.sequence(F.lit(0), F.size("segments"), F.lit(STRETCH)), lambda at: F.slice(F.col("segments"), at + 1, STRETCH))
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("machine.state").isin(*template.accepts).alias("valid"), F.col("machine.bad").alias("bad_turn"), "segments",
        F.array_join(F.transform("segments", lambda g: g["text"]), "").alias("formatted"), F.aggregate(stretches, none, stretch)["spans"].alias("loss_spans"),
    )


def read_turns(text: Column, template: Template = LLAMA) -> Column:
    """The turns (role, text) that a formatted string holds."""
    closes = sorted({r.close for r in (*template.roles.values(), template.other)}, key=lambda m: (-len(m), m))
    parts = F.split(text, "|".join(map(re.escape, closes)), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def read(part: Column) -> Column:
        end = F.instr(part, template.name_close)
        begin = len(template.name_open)
        role = unescaped(F.substring(part, begin + 1, end - begin - 1))
        rest = F.substring(part, end + len(template.name_close) + len(template.other.open), F.length(part))
        for name, r in template.roles.items():
            own = F.startswith(part, F.lit(r.open))
            role = F.when(own, F.lit(name)).otherwise(role)
            rest = F.when(own, F.substring(part, F.lit(len(r.open) + 1), F.length(part))).otherwise(rest)
        return F.struct(role.alias("role"), unescaped(rest).alias("text"))

    return F.transform(parts, read)


def read_back(done: DataFrame, template: Template = LLAMA) -> DataFrame:
    """The digest columns of ``formatted`` rows, from the string and the loss spans alone."""
    turns = F.col("read")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    got = done.withColumn("read", read_turns(F.col("formatted"), template)).withColumn("lost", lost)
    return got.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
