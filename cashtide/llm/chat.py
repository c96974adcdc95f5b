"""Chat formatting: turns to training text with loss flags, by a finite-state machine and a template.

A template declares the control strings around a turn, which roles bear loss, and which role may follow
which. Every turn becomes three segments: a header, the body and an end. Control strings inside a role or a
body are escaped by one backslash after their first character (one more if they were escaped before), so the
formatted text can be read back exactly. All of it is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = ""


def _default_order() -> dict[str, tuple[str, ...]]:
    return {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class Template:
    """What a formatted turn looks like, and the states of the machine.

    ``order`` maps a state to the roles it accepts; accepting a role makes it the state. A conversation is
    complete in one of the states ``final``. ``loss`` names the roles whose bodies are trained on.
    """

    begin: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    loss: tuple[str, ...] = ("assistant",)
    final: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(default_factory=_default_order)

    def __post_init__(self) -> None:
        for control in self.controls:
            if len(control) < 2 or control[0] in control[1:] or "\\" in control:
                raise ValueError(f"{control!r} cannot be escaped: its first character must be its own, without backslashes")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.between, self.end)

    def escape(self, text: Column) -> Column:
        for c in self.controls:
            text = F.regexp_replace(text, rf"{_quoted(c[0])}(\\*){_quoted(c[1:])}", _replacement(c[0] + "\\", c[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        for c in reversed(self.controls):
            text = F.regexp_replace(text, rf"{_quoted(c[0])}\\(\\*){_quoted(c[1:])}", _replacement(c[0], c[1:]))
        return text


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def _replacement(before: str, after: str) -> str:
    plain = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return f"{plain(before)}$1{plain(after)}"


def gathered(turns: DataFrame) -> DataFrame:
    """One row per conversation, its turns in order. A conversation is one training text, so one row."""
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _allowed(template: Template, state: Column, role: Column) -> Column:
    verdict = F.lit(False)
    for before, roles in template.order.items():
        verdict = verdict | (state == before) & role.isin(*roles)
    return verdict


def run_machine(template: Template, turns: Column) -> Column:
    """Struct (state, turns read, first bad turn from 0 or null) after all turns; a bad turn still sets the state."""
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(seen: Column, turn: Column) -> Column:
        bad = F.when(~_allowed(template, seen["state"], turn["role"]), seen["at"])
        return F.struct(
            turn["role"].alias("state"), (seen["at"] + 1).alias("at"), F.coalesce(seen["bad"], bad).alias("bad")
        )

    return F.aggregate(turns, begin, step)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted, valid, first_bad_turn.

    Rows are ordered by turn, ties by role and text; a null turn comes first, null roles and texts are empty,
    repeated rows are turns of their own, rows of null conv_id are one conversation. Every turn is formatted,
    also an unknown role or one out of order: ``valid`` says whether the machine accepted all of them and ended
    in a final state. Other columns are ignored.
    """
    template = template or Template()

    def segments(turn: Column) -> Column:
        header = F.concat(F.lit(template.begin), template.escape(turn["role"]), F.lit(template.between))
        parts = (
            (header, F.lit(False)),
            (template.escape(turn["text"]), turn["role"].isin(*template.loss)),
            (F.lit(template.end + "\n"), F.lit(False)),
        )
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))

    ended = gathered(turns).withColumn("machine", run_machine(template, F.col("turns")))
    return ended.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        (F.col("machine.bad").isNull() & F.col("machine.state").isin(*template.final)).alias("valid"),
        F.col("machine.bad").alias("first_bad_turn"),
    ).select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "valid", "first_bad_turn")


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) a formatted text was made from."""
    template = template or Template()
    whole = F.split(formatted, _quoted(template.end) + "\n", -1)

    def turn(written: Column) -> Column:
        inner = F.substring(written, F.lit(len(template.begin) + 1), F.length(written))
        parts = F.split(inner, _quoted(template.between), 2)
        return F.struct(template.unescape(parts[0]).alias("role"), template.unescape(parts[1]).alias("text"))

    return F.transform(F.slice(whole, 1, F.size(whole) - 1), turn)


def read_loss(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    template = template or Template()
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: template.unescape(s["text"])), "")
