"""Chat formatting in Spark expressions: turns become marked text that can be read back exactly.

A conversation's turn structs are collected and sorted, adjacent turns of one role share a block, and
blocks are concatenated::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n<|im_start|>role\\n...

Control strings inside texts are escaped: ``<|`` becomes ``<\\|`` and one backslash is added to every
``<\\\\...|``, which keeps the map reversible; in roles ``%``, line breaks and ``<|`` are
percent-encoded. No text can thus end a turn or open one. The loss mask lists the spans (start, length
in code points of the formatted text) of the assistant's texts, without markers.

Defined cases: a null text or role counts as empty; turns are ordered by turn (nulls first), ties by
role and text; repeated rows are repeated turns; conversations without rows don't exist; a null
conv_id is a conversation of its own. A conversation's output is one string, so its turns meet in one
row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    encoded = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.replace(encoded, F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    decoded = F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n"))
    return F.replace(decoded, F.lit("%25"), F.lit("%"))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted (string), loss (array of start, length) for rows of conv_id, turn, role, text."""
    turn = F.struct(
        "turn",
        escape_role(F.coalesce("role", F.lit(""))).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def opening(t: Column, i: Column) -> Column:
        """What stands between the previous text and this one: a new block, or a separator in it."""
        block = F.concat(F.lit(START), t["role"], F.lit("\n"))
        before = F.try_element_at(F.col("turns"), i)  # positions count from 1: the turn before turn i
        return (
            F.when(i == 0, block)
            .when(before["role"] == t["role"], F.lit(SEPARATOR))
            .otherwise(F.concat(F.lit(END + "\n"), block))
        )

    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            opening(t, i).alias("opening"), t["text"].alias("text"), (t["role"] == loss_role).alias("loss")
        ),
    )
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["opening"], p["text"])), "")

    def add(state: Column, p: Column) -> Column:
        start = state["position"] + F.length(p["opening"])
        span = F.array(F.struct(start.alias("start"), F.length(p["text"]).alias("length")))
        return F.struct(
            (start + F.length(p["text"])).alias("position"),
            F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.struct(
        F.lit(0).alias("position"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")
    )
    return sorted_turns.select("conv_id", "turns", pieces.alias("pieces")).select(
        "conv_id",
        F.concat(body, F.lit(END + "\n")).alias("formatted"),
        F.aggregate("pieces", empty, add, lambda s: s["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from the formatted text and its mask alone."""
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)

    def turns_of(block: Column) -> Column:
        line = F.locate("\n", block)
        role = unescape_role(F.substring(block, F.lit(len(START) + 1), line - len(START) - 1))
        texts = F.split(F.substring(block, line + 1, F.length(block)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what reading the formatted text gives back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_conversations(rows)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
