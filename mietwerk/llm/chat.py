"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks a turn, which roles are learned from, and which role may follow which.

    A turn becomes `open` role "\\n" text `close`. Inside a text, `<` followed by any backslashes and `|`
    gets one more backslash, so no control string survives in it; taking one backslash away restores it.
    A role has `%` and line feeds percent-encoded as well. Of all this, only the texts of `learned` roles
    carry loss. `moves` maps a state to the roles allowed next; a state is named after the last role.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, broken_at, segments array<struct<text, loss>>.

    `turns` has conv_id, turn, role, text; more columns are ignored. Rows are ordered by turn, then role
    and text, so repeated rows and ties have one order; a null turn comes first. A null role or text counts
    as empty. A null conv_id is a conversation of its own. `broken_at` is the index of the first turn that
    the machine refuses, or n_turns if it stops in a state that is not final; -1 if all is in order.
    Broken conversations are formatted all the same. An empty table gives no row. Each conversation must
    fit a row of Spark, as its text and digest do.
    """
    t = template
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    chats = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}\n{b}") for a, to in t.moves.items() for b in to])
    first = F.struct(F.lit(t.start).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("broken"))

    def step(acc: Column, x: Column) -> Column:
        move = F.concat(acc["state"], F.lit("\n"), x["role"])
        bad = F.when(F.array_contains(allowed, move), F.lit(None).cast("long")).otherwise(acc["at"])
        return F.struct(x["role"].alias("state"), (acc["at"] + 1).alias("at"), F.coalesce(acc["broken"], bad).alias("broken"))

    run = F.aggregate("turns", first, step)
    ended = F.when(~run["state"].isin(*t.final), F.size("turns").cast("long"))

    def segment(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.open), escape_role(x["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.learned).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    broken = F.coalesce(run["broken"], ended, F.lit(-1).cast("long"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        (broken < 0).alias("valid"),
        broken.alias("broken_at"),
        F.flatten(F.transform("turns", segment)).alias("segments"),
    )


def formatted(segments: Column | str = "segments") -> Column:
    """The whole text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_text(segments: Column | str = "segments") -> Column:
    """All text under the loss mask as it was before escaping, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    t = template
    parts = F.split(text, re.escape(t.open))
    turns = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda x: F.substring(x, F.locate("\n", x) + 1, F.length(x))

    def turn(x: Column) -> Column:
        inner = body(x)
        return F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(inner, F.lit(1), F.length(inner) - len(t.close))).alias("text"),
        )

    return F.transform(turns, turn)


def chat_digests(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests read back from the output of `format_chats`."""
    out = chats.withColumns({"_text": formatted(), "_loss": learned_text()}).withColumn("_turns", read_back(F.col("_text"), template))
    told = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("_text").cast("long").alias("formatted_chars"),
        "valid",
        "broken_at",
    )
