"""Chat formatting: a declarative template and a finite-state machine over roles.

A conversation becomes a list of text segments, each with a loss flag. Every
turn gives three: its opening (marker and role), its text and its closing. The
text of a trained role carries the loss, the rest never does. Turn order is
checked by a state machine given as a table; a conversation that breaks it is
still formatted, and reported with the turn that broke it.

Control strings inside roles and texts are escaped: a backslash is put before the
last character of ``<`` + backslashes + ``|``. One is taken away again on
reading, so escaping is reversible and no marker can be forged. Line breaks in a
role become ``<n``, by the same rule.

Defined cases: a null role or text is empty; rows are ordered by turn (null
first), then role, then text, and repeated rows stay; an unknown role breaks the
order; rows with a null conv_id form one conversation; no rows give no rows. A
formatted conversation is one value, so its length is bounded by what a string
can hold.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns

BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """``opening + role + after_role + text + closing`` for each turn."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    # (state, role) -> state; what is missing breaks the conversation.
    moves: Mapping[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        ("answered", "tool"): "asked", ("asked", "tool"): "asked",
    })
    final: tuple[str, ...] = ("answered",)


CHATML = Template()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escaped_role(role: Column) -> Column:
    guarded = F.regexp_replace(role, r"<(\\*)([|n])", r"<$1\\$2")
    return F.replace(guarded, F.lit("\n"), F.lit("<n"))


def unescaped_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n"), F.lit("\n")), r"<(\\*)\\([|n])", "<$1$2")


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, segments (array of text, loss),
    valid, ends_open (valid so far, but the last turn awaits an answer),
    broken_at (index of the first turn out of order, from 0)."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = own_columns(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        said = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            said(F.concat(F.lit(template.opening), escaped_role(t["role"]), F.lit(template.after_role)), no),
            said(escaped(t["text"]), t["role"].isin(*template.trained)),
            said(F.lit(template.closing), no))

    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])

    def step(acc: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat_ws("\n", acc["state"], t["role"])), F.lit(BROKEN))
        at = F.when(acc["broken_at"].isNotNull(), acc["broken_at"]).when(to == BROKEN, acc["seen"])
        return F.struct(to.alias("state"), at.cast("int").alias("broken_at"), (acc["seen"] + 1).cast("int").alias("seen"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("broken_at"), F.lit(0).cast("int").alias("seen"))
    return turns.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", begin, step).alias("end"),
    ).select(
        "conv_id", "segments",
        F.col("end.state").isin(*template.final).alias("valid"),
        (F.col("end.broken_at").isNull() & ~F.col("end.state").isin(*template.final)).alias("ends_open"),
        F.col("end.broken_at").alias("broken_at"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_back(text: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(text, _quoted(template.opening)), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, template.after_role, 1)
        start = F.length(role) + F.lit(len(template.after_role) + 1)
        length = F.length(p) - F.length(role) - F.lit(len(template.after_role) + len(template.closing))
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(p, start, length)).alias("text"))

    return F.transform(parts, turn)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
