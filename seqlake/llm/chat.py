"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, then its reply, which alone is trainable. Turns after the last reply
become a closing example without a target, so nothing of a conversation is
lost. The template marks turns with ``<|role|>``, newline, text, ``<|end|>``,
newline; in roles and texts, ``<|`` is written ``<\\|`` and a backslash after
``<`` and before further backslashes and a bar is doubled, so markers occur in
no text and escaping can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def escape(text: Column) -> Column:
    """``<``, any backslashes and ``|`` get one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, formatted, one array each."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), prompt, target: the text before the trainable part, and that part.

    The formatted example is ``concat(prompt, target, '<|end|>\\n')`` if target
    is not null, else ``prompt``. ``target`` is escaped like any text.

    Null roles and texts are empty. Turns are ordered by turn, then role, then
    text (null turns first), so ties and repeated rows have a fixed order.
    Rows with a null conv_id are one conversation. An empty table gives no
    examples. Other columns, whatever their names, are ignored.

    The examples' total length grows with the square of a conversation's
    turns, as each holds its whole context; each is built by joining a slice of
    one array. Turns of a conversation must fit in a task, as a training
    example must.
    """
    marked = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("is_target")),
    )
    held = _sorted_turns(conversations).select("conv_id", marked.alias("t"))
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["is_target"] | (i == F.size("t")))
    at = held.select("conv_id", "t", F.posexplode(places).alias("example", "i"))
    closing = ~F.element_at("t", F.col("i"))["is_target"]
    context = F.slice("t", F.lit(1), F.when(closing, F.col("i")).otherwise(F.col("i") - 1))
    before = F.array_join(F.transform(context, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    own = F.element_at("t", F.col("i"))
    return at.select("conv_id", "example", F.when(closing, before).otherwise(F.concat(before, own["head"])).alias("prompt"), F.when(~closing, own["body"]).alias("target"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted example, unescaped."""
    turns = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")

    def one(x: Column) -> Column:
        cut = F.locate("|>\n", x)
        return F.struct(unescape(F.substring(x, F.lit(3), cut - 3)).alias("role"), unescape(F.substring(x, cut + 3, F.length(x))).alias("text"))

    return F.transform(turns, one)


def digest(examples_: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The longest example holds all turns. formatted_chars counts the code points
    of all examples of the conversation.
    """
    formatted = F.when(F.col("target").isNull(), F.col("prompt")).otherwise(F.concat("prompt", "target", F.lit(END)))
    rows = examples_.select("conv_id", "example", F.length(formatted).cast("long").alias("n"), unescape(F.col("target")).alias("loss"), formatted.alias("formatted"))
    per = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.sum("n").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
    )
    read = per.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
