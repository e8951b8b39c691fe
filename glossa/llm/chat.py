"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative template says what stands before and after each turn, and lists the machine's moves
and the states whose turns count for the loss.  Control strings inside texts are escaped by a backslash, as are backslashes,
so that a formatted conversation reads back exactly.  DataFrame functions only.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """Every turn is written as begin + role + separator + text + end, each of them one of the control strings."""

    begin: str = "[INST]"
    separator: str = "[/INST]"
    end: str = "</s>"
    #: Control strings that a text may not contain unescaped.
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state.
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    #: A role that the state has no entry for is a violation, after which the machine goes on from here; others keep the state.
    resume: dict[str, str] = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant"})
    #: A turn that brings the machine into one of these states is under the loss mask.
    loss_states: tuple[str, ...] = ("assistant",)

    @property
    def states(self) -> list[str]:
        found = {self.start: None}
        for state, moves in self.machine.items():
            found |= {state: None} | dict.fromkeys(moves.values())
        return list(found | dict.fromkeys(self.resume.values()))

    @property
    def _special(self) -> str:
        return "|".join(re.escape(c).replace("<", "\\<").replace(">", "\\>").replace("/", "\\/") for c in (*sorted(self.control, key=len, reverse=True), "\\"))

    @property
    def _body(self) -> str:
        """A run of escaped text: escapes, or characters that start no control string."""
        return rf"(?:\\(?:{self._special})|(?!{self._special})[\s\S])*+"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(f"({self._special})"), F.lit("\\\\$1"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(rf"\\({self._special})"), F.lit("$1"))

    def turns(self, formatted: Column, part: str) -> Column:
        """All roles or all texts of a formatted conversation, read back."""
        q = lambda s: re.escape(s).replace("<", "\\<").replace(">", "\\>").replace("/", "\\/")
        pattern = q(self.begin) + f"({self._body})" + q(self.separator) + f"({self._body})" + q(self.end)
        return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1 if part == "role" else 2)), self.unescape)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, valid, first_violation, segments, formatted), a row for each conversation.

    ``turns`` has conv_id, turn, role, text.  Rows are ordered by turn, then role, then text (nulls
    first), and repeated rows are turns of their own.  A null text is empty, a null role is the
    empty role, rows of a null conv_id form one conversation.  The machine reads the roles in a row
    and emits for each turn the state that it is in, and so the turn's loss flag; every conversation
    is formatted, also where it finds a violation: ``valid`` is whether all turns were in order and
    the last state accepts, ``first_violation`` the index of the first turn out of order (null:
    none).  ``segments`` is array<struct<text, loss>> whose texts in a row are ``formatted``.  An
    empty table gives an empty result; further columns are ignored.
    """
    t = template or Template()
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # A state is one letter, so that what the machine emits is a short string.
    letter = {s: chr(ord("a") + i) for i, s in enumerate(t.states)}

    def step(acc: Column, r: Column) -> Column:
        to, again = F.lit(None).cast("string"), acc["state"]
        for state, moves in t.machine.items():
            for role, target in moves.items():
                to = F.when((acc["state"] == letter[state]) & (r["role"] == role), F.lit(letter[target])).otherwise(to)
        for role, target in t.resume.items():
            again = F.when(r["role"] == role, F.lit(letter[target])).otherwise(again)
        # A role without a place to resume emits no state.
        told = F.when(r["role"].isin(*t.resume), again).otherwise(F.lit("-"))
        return let(to, lambda new: F.struct(
            F.coalesce(new, again).alias("state"),
            F.coalesce(acc["bad"], F.when(new.isNull(), acc["i"])).alias("bad"),
            (acc["i"] + 1).alias("i"),
            F.concat(acc["out"], F.coalesce(new, told)).alias("out")))

    began = F.struct(F.lit(letter[t.start]).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("i"), F.lit("").alias("out"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    written = F.flatten(F.zip_with("rows", F.split("end.out", ""), lambda r, state: F.array(
        segment(F.concat(F.lit(t.begin), t.escape(r["role"]), F.lit(t.separator)), F.lit(False)),
        segment(t.escape(r["text"]), state.isin(*(letter[s] for s in t.loss_states))),
        segment(F.lit(t.end), F.lit(False)))))
    return (convs.select("conv_id", "rows", F.aggregate("rows", began, step).alias("end"))
            .select("conv_id", (F.col("end.bad").isNull() & F.col("end.state").isin(*(letter[s] for s in t.accepting))).alias("valid"), F.col("end.bad").alias("first_violation"), written.alias("segments"))
            .select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read the formatted conversations back: turns from the text, the loss from the mask."""
    t = template or Template()
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
    read = formatted.select("conv_id", "valid", "first_violation", F.arrays_zip(t.turns(F.col("formatted"), "role").alias("role"), t.turns(F.col("formatted"), "text").alias("text")).alias("turns"),
                            loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "valid", F.col("first_violation").cast("long").alias("first_violation"))
