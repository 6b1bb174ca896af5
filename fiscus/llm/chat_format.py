r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its reply is under the loss mask. A turn is written as
``<s>role<:>text</s>``. Inside roles and texts ``<`` becomes ``<\`` and ``\``
becomes ``\\``, so no control string can appear there and the writing is
reversible. A conversation that does not end with an assistant turn gets one more
example without a target, so that no turn is lost.

The expansion repeats the context for each reply: its output grows with the
square of the turns of one conversation, by definition of the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, BODY, CLOSE = "<s>", "<:>", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\\])\\", "$1")


def format_examples(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per example: id, ``example_no``, ``formatted``, ``loss_start`` (from 0), ``loss_length``, ``is_last``.

    ``loss_start`` and ``loss_length`` count code points of ``formatted``.
    Null roles and texts count as empty, null ids form one conversation.
    Equal turn numbers are ordered by role, then text, nulls first; repeated
    rows are repeated turns. An empty table has no examples. Further columns
    are ignored.

    A conversation is one row while it is formatted, as is its longest example in any case.
    """
    ordered = (
        turns.select(
            F.col(id_col).alias("conv"),
            F.struct(
                F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
            ).alias("said"),
        )
        .groupBy("conv")
        .agg(F.sort_array(F.collect_list("said")).alias("said"))
    )
    written = ordered.select(
        "conv",
        F.size("said").alias("turns"),
        F.transform(
            "said",
            lambda t: F.struct(
                F.coalesce(t["role"], F.lit("")).alias("role"),
                F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(BODY)).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("said"),
    )
    last_is_reply = F.element_at("said", -1)["role"] == ASSISTANT
    ends = F.filter(
        F.sequence(F.lit(1), F.col("turns")),
        lambda k: (F.element_at("said", k)["role"] == ASSISTANT) | ((k == F.col("turns")) & ~last_is_reply),
    )
    exploded = written.select("conv", "turns", "said", F.posexplode(ends).alias("example_no", "end"))
    target = F.element_at("said", F.col("end"))
    before = F.transform(
        F.slice("said", F.lit(1), F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))
    )
    prompt = F.concat(F.array_join(before, ""), target["head"])
    return exploded.select(
        F.col("conv").alias(id_col),
        "example_no",
        prompt.alias("prompt"),
        target["body"].alias("body"),
        (target["role"] == ASSISTANT).alias("has_target"),
        (F.col("end") == F.col("turns")).alias("is_last"),
    ).select(
        id_col,
        "example_no",
        F.concat("prompt", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("prompt").alias("loss_start"),
        F.when(F.col("has_target"), F.length("body")).otherwise(0).alias("loss_length"),
        "is_last",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda part: F.struct(
            unescaped(F.substring_index(F.substring(part, len(OPEN) + 1, 2**31 - 1), BODY, 1)).alias("role"),
            unescaped(F.substring_index(part, BODY, -1)).alias("text"),
        ),
    )


def digest_examples(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, all of it read back from the formatted examples."""
    reply = F.expr("substring(formatted, loss_start + 1, loss_length)")
    read = examples.select(
        id_col,
        F.length("formatted").alias("chars"),
        F.struct("example_no", unescaped(reply).alias("reply")).alias("reply"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("said"),
    ).select(
        id_col,
        "chars",
        "reply",
        F.size("said").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
    )
    replies = F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["reply"]), "")
    return (
        read.groupBy(id_col)
        .agg(
            F.max(F.when(F.col("turns_sha256").isNotNull(), F.col("n_turns"))).cast("long").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            replies.alias("replies"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            id_col,
            "n_turns",
            "turns_sha256",
            F.length("replies").cast("long").alias("loss_chars"),
            F.sha2("replies", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
