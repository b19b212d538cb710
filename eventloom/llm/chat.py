"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (then role, then text, for
ties); adjacent turns of one role are merged into a block and the blocks are concatenated, both by one
array aggregation (transform with a look at either neighbour, then array_join). A block is

    <s>[INST]role[/INST]text<sep>text</s>

In roles and texts a backslash is doubled and a control string gets a backslash after its first
character, so no control string is left in them and `read_back` recovers every turn exactly, with the
characters that a loss mask over assistant texts covers.

A null role or text counts as empty. Rows with equal turn are all kept. Rows with null conv_id make one
conversation of null id. An empty table gives an empty result. The text of one conversation must fit
into one value (2 GB), as the formatted conversation is one; nothing larger than that is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, SEP, END = "<s>", "[INST]", "[/INST]", "<sep>", "</s>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    text = F.regexp_replace(text, r"<(?=/?s>|sep>)", r"<\\")
    return F.regexp_replace(text, r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: the id and `formatted`."""
    row = F.struct(turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    ordered = turns.groupBy(turns[conv].alias(conv)).agg(F.collect_list(row).alias("rows")).select(conv, F.array_sort("rows").alias("rows"))
    rows, n = F.col("rows"), F.size("rows")

    def piece(x: Column, i: Column) -> Column:
        """A turn with what opens, continues or ends its block: one pass over the array, whatever its length."""
        opens = (i == 0) | (F.get(rows, i - 1)["role"] != x["role"])
        ends = (i == n - 1) | (F.get(rows, i + 1)["role"] != x["role"])
        return F.concat(
            F.when(opens, F.concat(F.lit(BEGIN + OPEN), escape(x["role"]), F.lit(CLOSE))).otherwise(F.lit(SEP)),
            escape(x["text"]),
            F.when(ends, F.lit(END)).otherwise(F.lit("")),
        )

    return ordered.select(conv, F.array_join(F.transform("rows", piece), "").alias("formatted"))


def read_back(formatted: DataFrame, conv: str = "conv_id", masked_role: str = "assistant") -> DataFrame:
    """From `formatted` alone: turns array<struct<role, text>>, and loss array<string>, the texts under the loss mask."""
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    parts = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(F.substring(b, len(BEGIN + OPEN) + 1, 1 << 30), CLOSE, 1)).alias("role"),
            F.split(F.substring(b, F.instr(b, CLOSE) + F.lit(len(CLOSE)), F.lit(1 << 30)), SEP, -1).alias("texts"),
        ),
    )
    turns = F.flatten(F.transform(parts, lambda p: F.transform(p["texts"], lambda t: F.struct(p["role"].alias("role"), unescape(t).alias("text")))))
    return formatted.select(conv, "formatted", turns.alias("turns")).select(
        conv, "formatted", "turns", F.transform(F.filter("turns", lambda t: t["role"] == masked_role), lambda t: t["text"]).alias("loss")
    )
