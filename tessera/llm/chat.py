"""Chat formatting with Spark expressions only.

A conversation's rows are collected as turn structs and sorted; adjacent turns
of one role become one block; blocks are concatenated in this template:

    [INST]role[/INST]text[SEP]text</s>[INST]role[/INST]text</s>

A control string inside a text or a role gets a backslash before its closing
character (``</s>`` -> ``</s\\>``), one that already carries backslashes gets
one more, so no control string is left in an escaped text and unescaping
restores it exactly.

Defined cases: null role or text is the empty string; rows are ordered by turn
(null first), then role, then text, so repeated turns have a fixed order and
each is kept; rows with a null conv_id form one conversation; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template (fixed values).
OPEN, CLOSE, NEXT, END = "[INST]", "[/INST]", "[SEP]", "</s>"

_CONTROL = r"(\[INST|\[/INST|\[SEP|</s)(\\*)([\]>])"
_ESCAPED = r"(\[INST|\[/INST|\[SEP|</s)\\(\\*)([\]>])"


def escape(col: Column) -> Column:
    return F.regexp_replace(col, _CONTROL, r"$1\\$2$3")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, _ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows -> one row per conversation.

    Returns conv_id, ``formatted`` and ``segments``, an array of (text, loss)
    whose texts concatenate to ``formatted``; ``loss`` marks the characters a
    model is trained on: the texts of ``loss_role``, without template marks.
    """
    turns = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t")
    )
    t = F.col("_t")

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"])

    starts = sorted_turns.withColumn(
        "_s", F.filter(F.sequence(F.lit(0), F.size(t) - 1), begins)
    )
    s = F.col("_s")

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(s, k + 1), F.size(t))
        return F.struct(
            F.get(t, start)["role"].alias("role"),
            F.transform(F.slice(t, start + 1, stop - start), lambda x: escape(x["text"])).alias("texts"),
        )

    blocks = starts.select("conv_id", F.transform(s, block).alias("_b"))

    def mark(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def pieces(b: Column) -> Column:
        texts = F.flatten(
            F.transform(
                b["texts"],
                lambda x, i: F.array(
                    mark(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit(""))),
                    F.struct(x.alias("text"), (b["role"] == loss_role).alias("loss")),
                ),
            )
        )
        head = mark(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE)))
        return F.concat(F.array(head), texts, F.array(mark(F.lit(END))))

    segments = blocks.select("conv_id", F.flatten(F.transform("_b", pieces)).alias("segments"))
    return segments.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        "segments",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), CLOSE, 1))
        body = F.substr(b, F.instr(b, CLOSE) + len(CLOSE))
        return F.transform(
            F.split(body, r"\[SEP\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """The texts under the loss mask, unescaped: array of strings."""
    return F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescape(x["text"]))
