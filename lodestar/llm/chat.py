"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns
as context and only that reply under the loss mask. Turns behind the last
reply form one more example without a target, so that the output holds
every turn.

A turn is written ``<|role|>\\ntext<|end|>\\n``. Control strings inside
roles and texts get a backslash behind their first character and
backslashes are doubled, which ``unescape`` reverts; so none of them
appears in a formatted text but as the template's own mark.

Defined cases: null roles and texts are empty, an empty conversation
table gives no examples, equal turn numbers are ordered by role and text,
a null turn number comes last, a null conv_id is a conversation of its
own, repeated rows are turns of their own, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import let

# Strings that steer chat templates.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>")
END = "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for c in reversed(CONTROL):
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of a conversation in order, formatted:
    array of (role, head, body), which concatenate to the turn."""
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(
        t["role"].alias("role"), F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"),
        escape(t["text"]).alias("body")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             reply: str = "assistant") -> DataFrame:
    """One row per example: conv_id, upto (turns it holds), is_last (it
    holds the whole conversation), formatted, loss_start and loss_end
    (code points of the reply's text, null without a target)."""
    held = conversations(df, conv, turn, role, text).withColumn("at", F.explode(F.filter(
        F.sequence(F.lit(1), F.size("turns")), lambda i: (i == F.size("turns")) | (
            F.element_at("turns", i)["role"] == reply))))
    body = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    context = F.array_join(F.slice(body, 1, F.col("at") - 1), "")
    target = F.element_at("turns", F.col("at"))
    cut = held.select("conv_id", F.col("at").alias("upto"), (F.col("at") == F.size("turns")).alias("is_last"),
                      context.alias("context"), target.alias("target"))
    trained = F.col("target.role") == reply
    first = F.length("context") + F.length("target.head")
    return cut.select("conv_id", "upto", "is_last",
                      F.concat("context", "target.head", "target.body", F.lit(END)).alias("formatted"),
                      F.when(trained, first).cast("long").alias("loss_start"),
                      F.when(trained, first + F.length("target.body")).cast("long").alias("loss_end"))


def masked(formatted: str = "formatted", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The unescaped text under the loss mask (null without one)."""
    return unescape(F.substring(F.col(formatted), (F.col(start) + 1).cast("int"),
                                (F.col(end) - F.col(start)).cast("int")))


def parsed(formatted: Column) -> Column:
    """The turns read back from a formatted text: array of (role, text)."""
    def turn(piece):
        return let(F.locate("|>\n", piece), lambda at: F.struct(
            unescape(F.substring(piece, F.lit(3), at - 3)).alias("role"),
            unescape(F.substring(piece, at + 3, F.length(piece))).alias("text")))
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1)), turn)
