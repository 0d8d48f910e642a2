"""Relational chat formatting: Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share a header,
with a part mark between their texts; everything is concatenated into one string. Control strings inside
texts and roles are escaped by a backslash after their first character (backslashes are doubled), so that
the output can be read back without loss: ``turns`` is the inverse of ``format_conversations``.

Defined results: a null text or role is the empty text; turns sort by (turn, role, text), nulls first, so
repeated rows and ties have a fixed order and are all kept; rows with a null conv_id are one conversation;
a conversation is one output row and has to fit into one; an empty table gives no rows. Other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Segments of a block of running sums.
BLOCK = 128


@dataclass(frozen=True)
class Template:
    """Marks of the format; ``foreign``: control strings of other formats that texts mustn't hold either."""

    start: str = "<|im_start|>"
    head_end: str = "<|im_sep|>"
    part: str = "<|im_part|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def controls(self) -> tuple[str, ...]:
        marks = (self.start, self.head_end, self.part, self.end)
        if any(len(m) < 2 or "\\" in m for m in (*marks, *self.foreign)):
            raise ValueError("a control string has two characters at least and no backslash")
        return tuple(dict.fromkeys((*marks, *self.foreign)))


def escape(text: Column, template: Template) -> Column:
    """``text`` without any control string, reversibly."""
    rests: dict[str, list[str]] = {}
    for mark in template.controls():
        rests.setdefault(mark[0], []).append(re.escape(mark[1:]))
    pattern = "|".join(f"{re.escape(first)}(?={'|'.join(rest)})" for first, rest in rests.items())
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({pattern})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, mask): ``mask`` has the (start, length) in ``formatted``, from 1, of each span under the
    loss mask, the escaped texts of ``template.learned`` roles, in order."""
    t = template
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct("turn", empty("role").alias("role"), empty("text").alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def pieces(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("rows"), i - 1)["role"] == x["role"])
        close = F.when(i > 0, F.lit(t.end + t.after)).otherwise(F.lit(""))
        head = F.concat(close, F.lit(t.start), escape(x["role"], t), F.lit(t.head_end))
        mark = F.struct(F.when(same, F.lit(t.part)).otherwise(head).alias("text"), F.lit(False).alias("loss"))
        said = F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.learned).alias("loss"))
        return F.array(mark, said)

    last = F.array(F.struct(F.lit(t.end + t.after).alias("text"), F.lit(False).alias("loss")))
    cut = sorted_turns.select("conv_id", F.concat(F.flatten(F.transform("rows", pieces)), last).alias("segments"))
    # Generators of one row: each step is there once, and isn't computed anew for each segment of the next.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    cut = cut.select("conv_id", once(F.col("segments"), "segments"))
    cut = cut.select("conv_id", "segments", once(F.transform("segments", lambda s: F.length(s["text"])), "sizes"))
    # Places are running sums in two levels, by blocks, so that long conversations don't take quadratic time.
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / BLOCK).cast("int"))
    cut = cut.select("*", once(F.transform(blocks, lambda b: total(F.slice("sizes", b * BLOCK + 1, F.lit(BLOCK)))), "sums"))
    cut = cut.select("*", once(F.transform("sums", lambda x, b: total(F.slice("sums", F.lit(1), b))), "starts"))
    first = lambda i: F.get("starts", F.floor(i / BLOCK).cast("int")) + total(F.slice("sizes", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    spans = F.transform("segments", lambda s, i: F.when(s["loss"], F.struct((first(i) + 1).alias("start"), F.length(s["text"]).alias("length"))))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.array_compact(spans).alias("mask"))


def turns(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation."""
    t = template

    def block(b: Column) -> Column:
        body = F.substring_index(b, t.end, 1)
        role = unescape(F.substring_index(body, t.head_end, 1))
        parts = F.split(F.substring_index(body, t.head_end, -1), re.escape(t.part))
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.split(formatted, re.escape(t.start))
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, cut out of the formatted text and unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"], m["length"]))), "")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What can be read back from each conversation: number and digest of its turns, and of the learned text."""
    read = formatted.select("conv_id", "formatted", turns(F.col("formatted"), template).alias("t"), learned_text(F.col("formatted"), F.col("mask")).alias("l"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
