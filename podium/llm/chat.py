"""Operator 1, chat formatting: relational, with Spark expressions only.

A conversation becomes one string. Turns are sorted by (turn, role, text); nulls come first, a null role or text counts
as empty, so ties and repeated rows have one defined order and all of them stay. Adjacent turns of one role form one
block, whose parts keep their borders:

    <|turn|>ROLE<|says|>TEXT[<|next|>TEXT ...]<|end|>

Escaping is reversible: a backslash doubles, and backslash-exclamation mark is put into the second place of anything
that looks like the start of a control string of this or of a common other template. So an escaped text holds no
control string, and taking the marks out gives back the text.

A row without a conv_id belongs to the conversation null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
#: First characters of control strings: of this template, then of other public chat templates.
OPENERS = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, OPENERS, r"$1\\!")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role, by one aggregation over the sorted array."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        fresh = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        grown = F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
        same = (F.size(blocks) > 0) & (last["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), grown)).otherwise(F.concat(blocks, fresh))

    return F.aggregate(turns, empty, add)


def pieces(blocks: Column, trained_role: str) -> Column:
    """The output as an array of (piece, masked): control strings and roles unmasked, texts of the trained role masked."""

    def piece(text: Column, masked: Column | bool) -> Column:
        return F.struct(text.alias("piece"), (F.lit(masked) if isinstance(masked, bool) else masked).alias("masked"))

    def block(b: Column) -> Column:
        head = F.array(piece(F.concat(F.lit(TURN), b["role"], F.lit(SAYS)), False))
        body = F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.array(
                    piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), False), piece(t, b["role"] == F.lit(trained_role))
                ),
            )
        )
        return F.concat(head, body, F.array(piece(F.lit(END), False)))

    return F.flatten(F.transform(blocks, block))


def spans(parts: Column) -> Column:
    """Masked spans (start, length) in code points of the joined pieces."""
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found")
    )

    def add(acc: Column, p: Column) -> Column:
        size = F.char_length(p["piece"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct(
            (acc["at"] + size).alias("at"),
            F.when(p["masked"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(parts, start, add, lambda acc: acc["found"])


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    # ties are settled by the texts as they are, so they are escaped once they are in order
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    parts = sorted_turns.select("conv_id", escaped.alias("turns"))
    parts = parts.select("conv_id", pieces(merged(F.col("turns")), escape_value(trained_role)).alias("parts"))
    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        spans(F.col("parts")).alias("loss_spans"),
    )


def escape_value(role: str) -> str:
    """The trained role as it stands in the output; roles with control strings can't be trained on."""
    if any(c in role for c in "\\<["):
        raise ValueError(f"trained role {role!r} holds characters of control strings")
    return role


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_text) parsed from the output alone."""
    blocks = F.filter(F.split("formatted", _quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(TURN) + 1)), SAYS, 1)
        texts = F.substr(block, F.char_length(role) + F.lit(len(TURN) + len(SAYS) + 1))
        return F.transform(
            F.split(texts, _quoted(NEXT)),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    loss = F.transform(
        "loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )
    return formatted.select(
        "*", F.flatten(F.transform(blocks, turns)).alias("turns"), unescape(F.array_join(loss, "")).alias("loss_text")
    )


def digests(back: DataFrame) -> DataFrame:
    """The query's columns, from what was read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
