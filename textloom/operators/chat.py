"""Conversations as training sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.operators.encode import encode
from textloom.operators.pack import MAX_LENGTH, STRIDE, pack
from textloom.operators.words import WORD_PATTERN, words_of
from textloom.plans.grouped import running_totals

# Special tokens of the chat format and the default role.
BEGIN_OF_TEXT, END_OF_TEXT = "<|begin_of_text|>", "<|end_of_text|>"
START_HEADER, END_HEADER = "<|start_header_id|>", "<|end_header_id|>"
END_OF_TURN = "<|eot_id|>"
PARAGRAPH = "\n\n"
CHAT_SPECIALS = [BEGIN_OF_TEXT, END_OF_TEXT, START_HEADER, END_HEADER, END_OF_TURN, PARAGRAPH]
USER_ROLE = "प्रयोगकर्ता"

TURNS_PER_PART = 1024


def header_text(role: Column) -> Column:
    return F.concat(F.lit(START_HEADER), role, F.lit(END_HEADER + PARAGRAPH))


def turn_text(text: Column, role: Column | None = None) -> Column:
    """Header, stripped content and end-of-turn mark of one message."""
    return F.concat(header_text(F.lit(USER_ROLE) if role is None else role), strip(text), F.lit(END_OF_TURN))


def header_ids(role_ids: Column, special: dict[str, int]) -> Column:
    return F.concat(F.array(F.lit(special[START_HEADER])), role_ids, F.array(F.lit(special[END_HEADER]), F.lit(special[PARAGRAPH])))


def turn_ids(role_ids: Column, content_ids: Column, special: dict[str, int]) -> Column:
    return F.concat(header_ids(role_ids, special), content_ids, F.array(F.lit(special[END_OF_TURN])))


def encode_turns(
    df: DataFrame, merges: DataFrame, vocab: DataFrame, special: dict[str, int], role: str = "role", text: str = "text",
    pattern: str = WORD_PATTERN, name: str = "ids",
) -> DataFrame:
    """Ids of each message in chat form."""
    out = encode(df, words_of(F.col(role), pattern), merges, vocab, "_role_ids")
    out = encode(out, words_of(strip(F.col(text)), pattern), merges, vocab, "_text_ids")
    return out.withColumn(name, turn_ids(F.col("_role_ids"), F.col("_text_ids"), special)).drop("_role_ids", "_text_ids")


def _said(role: str, text: str) -> Column:
    return turn_text(F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(USER_ROLE)))


def placed_turns(
    df: DataFrame, key: Sequence[str] = ("conv_id",), turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(key.., turn, start, n_chars, text)``: each turn in chat form and its place in its conversation.

    ``start`` counts the characters of earlier turns, ``n_chars`` those of all.
    One row per turn, so a conversation may have any length: a long one is
    summed in ranges of turns and never gathered. ``turn`` is unique in its
    conversation. A null text is an empty one, a null role the default one.
    """
    rows = df.select(*key, turn, _said(role, text).alias("text"))
    sized = running_totals(rows, key, [turn], {"start": F.length("text").cast("bigint")}, totals={"n_chars": "start"})
    return sized.select(*key, turn, "start", "n_chars", "text")


def conversation_windows(
    turns: DataFrame, key: Sequence[str] = ("conv_id",), turn: str = "turn", ids: str = "ids",
    max_length: int = MAX_LENGTH, stride: int = STRIDE,
) -> DataFrame:
    """Windows over the ids of all turns of a conversation, however many there are.

    ``turns`` is what ``encode_turns`` returns, written once: it is read twice.
    Windows cross turns, not conversations.
    """
    return pack(turns, key, turn, ids, max_length, stride)


def render_conversations(
    df: DataFrame, key: Sequence[str] = ("conv_id",), turn: str = "turn", role: str = "role", text: str = "text",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """``(key.., part, n_turns, text)``: the turns of a conversation in order.

    A conversation of up to ``turns_per_part`` turns is one row. A longer one
    continues in further parts, so that no row and no task has to hold a
    conversation of any length; concatenating the parts gives the whole.
    ``placed_turns`` and ``conversation_windows`` have one form at every length.
    A null text is an empty one, a null role the default one.
    """
    part = F.floor(F.col(turn) / turns_per_part).cast("bigint")
    message = F.struct(turn, _said(role, text).alias("said"))
    parts = df.groupBy(*key, part.alias("part")).agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(message)).alias("_m")
    )
    return parts.select(*key, "part", "n_turns", F.array_join(F.col("_m.said"), "").alias("text"))
