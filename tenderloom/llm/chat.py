"""Conversations of typed content parts as one string each, with a loss mask and the attachments it refers to.

A visitor holds, for each kind of part, how it is shown and how many tokens it takes; the visitors compile into one
expression. Text is shown escaped. Images, audio and documents are shown as numbered placeholders, in order, and recorded
with their reference, their expanded token count and their place. A turn is shown as

    <s>role[INST]content[/INST]</s>

and inside roles and texts a backslash is put after the first character of whatever reads like a control string, with any
backslashes that stand there already, so that taking one away again gives the text back. The loss mask is a list
of spans (code points, end exclusive) over the contents of the roles that are to be learned.

Null roles, texts and part lists count as empty; parts of an unknown or null kind are shown as nothing. Turns are in
order of their number, null first; equal numbers in order of role and content, and a repeated row is a turn of its own.
Rows without a conversation id are conversations of one turn each. A conversation becomes one value, so all its turns
meet in one row: that is the result asked for, and its size is that of the conversation.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(s>|/s>|INST\]|/INST\]|\|)"

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


@dataclasses.dataclass(frozen=True)
class Visitor:
    """What becomes of a part of one kind: the tokens it expands to; None for text, which is shown itself."""

    tokens: Callable[[Column], Column] | None


def _at_least_one(value: Column) -> Column:
    return F.greatest(F.coalesce(F.ceil(value), F.lit(1)), F.lit(1)).cast("long")


VISITORS = {
    "text": Visitor(None),
    "image": Visitor(lambda part: _at_least_one(F.ceil(part["width"] / 28) * F.ceil(part["height"] / 28))),
    "audio": Visitor(lambda part: _at_least_one(part["seconds"] * 25)),
    "document": Visitor(lambda part: _at_least_one(part["pages"] * 512)),
}


def text_part(text: Column) -> Column:
    """A list of parts with just a text."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    )


def _attached(kinds: Sequence[str]) -> Callable[[Column], Column]:
    return lambda part: F.coalesce(part["kind"].isin(*kinds), F.lit(False))


def visit(parts: Column, visitors: dict[str, Visitor] = VISITORS) -> Column:
    """A list of shown parts: shown, and for attachments kind, ref and n_tokens."""
    attachments = [kind for kind, visitor in visitors.items() if visitor.tokens]

    def one(part: Column) -> Column:
        shown, tokens = F.lit(""), F.lit(None).cast("long")
        for kind, visitor in visitors.items():
            here = part["kind"] == kind
            if visitor.tokens is None:
                shown = F.when(here, escape(F.coalesce(part["text"], F.lit("")))).otherwise(shown)
            else:
                shown = F.when(here, F.lit(f"<|{kind}|>")).otherwise(shown)
                tokens = F.when(here, visitor.tokens(part)).otherwise(tokens)
        kept = _attached(attachments)(part)
        return F.struct(
            shown.alias("shown"), F.when(kept, part["kind"]).alias("kind"), F.when(kept, part["ref"]).alias("ref"),
            tokens.alias("n_tokens"),
        )

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def _attachments(parts: Column, place: Column) -> Column:
    """Attachments of a turn whose content begins at `place`, each with its own place. Only turns with attachments
    pay for the running sum."""
    start = F.struct(place.alias("at"), F.array().cast(
        "array<struct<kind: string, ref: string, n_tokens: bigint, place: bigint>>").alias("found"))

    def add(seen: Column, part: Column) -> Column:
        row = F.struct(part["kind"], part["ref"], part["n_tokens"], seen["at"].alias("place"))
        found = F.when(part["kind"].isNotNull(), F.concat(seen["found"], F.array(row))).otherwise(seen["found"])
        return F.struct((seen["at"] + F.length(part["shown"])).alias("at"), found.alias("found"))

    some = F.exists(parts, lambda part: part["kind"].isNotNull())
    return F.when(some, F.aggregate(parts, start, add, lambda seen: seen["found"]))


def format_chats(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    learned: Sequence[str] = ("assistant",),
    visitors: dict[str, Visitor] = VISITORS,
) -> DataFrame:
    """One row for each conversation: its id, n_turns, formatted, loss_spans, attachments (kind, ref, n_tokens, place)
    and n_tokens_attached. One shuffle, on the conversation."""
    length = lambda c: F.length(c).cast("long")
    rows = messages.select(
        F.col(f"`{conversation}`").alias("conversation"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        visit(F.col(f"`{parts}`"), visitors).alias("parts"),
    )
    rows = (
        rows.withColumn("content", F.array_join(F.transform("parts", lambda part: part["shown"]), ""))
        .withColumn("head", F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(OPEN)))
        .withColumn("shown", F.concat("head", "content", F.lit(CLOSE + END)))
        .withColumn("alone", F.when(F.col("conversation").isNull(), F.monotonically_increasing_id()))
    )
    same = Window.partitionBy("conversation", "alone").orderBy("turn", "role", "content")
    before = F.sum(length(F.col("shown"))).over(same.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("place", F.coalesce(before, F.lit(0)) ).withColumn(
        "begins", F.col("place") + length(F.col("head"))
    )
    taken = placed.groupBy("conversation", "alone").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "place",
                    "shown",
                    F.when(
                        F.col("role").isin(*learned),
                        F.struct(F.col("begins").alias("start"), (F.col("begins") + length(F.col("content"))).alias("end")),
                    ).alias("loss"),
                    _attachments(F.col("parts"), F.col("begins")).alias("attachments"),
                )
            )
        ).alias("turns")
    )
    attached = F.flatten(F.filter(F.transform("turns", lambda t: t["attachments"]), lambda a: a.isNotNull()))
    return taken.select(
        F.col("conversation").alias(conversation),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
    ).withColumn(
        "n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: a list of role and text, unescaped."""

    def one(shown: Column) -> Column:
        role = F.substring_index(shown, OPEN, 1)
        used = F.length(role) + len(OPEN)
        text = shown.substr(used + 1, F.length(shown) - used - len(CLOSE + END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(F.split(formatted, BEGIN), lambda shown: shown != ""), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "",
    )
