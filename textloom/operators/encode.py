"""Text to ids and back.

Encoding and decoding look a vocabulary up for every token. While it is at most
``MAX_LOOKUP`` rows, checked by a count, it travels to the tasks as one
table and texts are mapped in place, with no shuffle at all; for a larger one
see ``operators.lexicon``. All items of some rows are found at once in Arrow, so
a task holds neither words nor ids as Python objects, but for the distinct words
of ``_ITEMS`` items and those it remembers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.lexicon import look_up

MAX_LOOKUP = 300_000  # vocabulary rows that may go to every task
_CACHE = 200_000  # words a task remembers
_ITEMS = 1 << 20  # items found at once, and one row more at most

UNK_ID = 1
IDS = T.ArrayType(T.IntegerType())
PIECES = T.ArrayType(T.StringType())


def lookup_rows(table: DataFrame, limit: int = MAX_LOOKUP) -> list | None:
    """The rows of a small table, or None when it has more than ``limit``."""
    rows = table.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _runs(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of whole rows with about ``most`` items."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield lists.slice(at, to - at)
        at = to


def _laid_out(lists: pa.Array, values: pa.Array, before: np.ndarray | None = None) -> pa.Array:
    """``values`` in the rows of ``lists``; item ``i`` has those from ``before[i]`` on, or one."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    ends = (ends if before is None else before[ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=lists.is_null() if lists.null_count else None)


def _in_runs(lists: pa.Array, found: Callable[[pa.Array], pa.Array], kind: pa.DataType, most: int = _ITEMS) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *[found(run).cast(kind) for run in _runs(lists, most)]])


def encode_words(
    df: DataFrame,
    words: Column,
    vocab: DataFrame,
    key: list[str],
    name: str = "ids",
    unk_id: int | None = UNK_ID,
    limit: int = MAX_LOOKUP,
) -> DataFrame:
    """Ids of the words of each row; unknown words get ``unk_id`` or, if that is None, fail.

    ``key`` names a row for its readers; neither form needs it to be unique.
    """
    rows = lookup_rows(vocab.select("token", "id"), limit)
    if rows is None:
        coded = look_up(df, words, vocab, "token", "id", name, required=unk_id is None)
        return coded if unk_id is None else coded.withColumn(name, F.transform(name, lambda i: F.coalesce(i, F.lit(unk_id))))
    table = {r.token: r.id for r in rows}
    sent = df.sparkSession.sparkContext.broadcast((pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int32())))

    @F.arrow_udf(IDS)
    def encode(batch: pa.Array) -> pa.Array:
        tokens, ids = sent.value

        def found(lists: pa.Array) -> pa.Array:
            items = lists.flatten()
            at = pc.index_in(items, value_set=tokens)
            if unk_id is None and at.null_count:
                raise KeyError(items.filter(at.is_null())[0].as_py())
            values = ids.take(at)
            return _laid_out(lists, values if unk_id is None else pc.fill_null(values, unk_id))

        return _in_runs(batch, found, pa.list_(pa.int32()))

    return df.withColumn(name, encode(words))


def decode(df: DataFrame, ids: Column, vocab: DataFrame, key: list[str], name: str = "text", word_end: str | None = "</w>",
           limit: int = MAX_LOOKUP, unk: str | None = None) -> DataFrame:
    """Text of an id array: pieces joined, the word-end mark read as a space.

    An id that is not in the vocabulary reads as ``unk`` or, if that is None, fails.
    """
    rows = lookup_rows(vocab.select("token", "id"), limit)
    sep = " " if word_end is None else ""
    if rows is None:
        piece_lists = look_up(df, ids, vocab, "id", "token", "_pieces")
        missing = F.raise_error(F.lit("id not in vocabulary")).cast("string") if unk is None else F.lit(unk)
        joined = F.array_join(F.transform("_pieces", lambda p: F.coalesce(p, missing)), sep)
    else:
        table = {r.id: r.token for r in rows}
        sent = df.sparkSession.sparkContext.broadcast((pa.array(list(table), pa.int64()), pa.array(list(table.values()), pa.string())))

        @F.arrow_udf("string")
        def text(batch: pa.Array) -> pa.Array:
            known, tokens = sent.value

            def found(lists: pa.Array) -> pa.Array:
                pieces = tokens.take(pc.index_in(lists.flatten().cast(pa.int64()), value_set=known))
                if pieces.null_count and unk is None:
                    raise ValueError("id not in vocabulary")
                return pc.binary_join(_laid_out(lists, pieces if unk is None else pc.fill_null(pieces, unk)), sep)

            return _in_runs(batch, found, pa.string())

        piece_lists, joined = df.withColumn("_pieces", text(ids)), F.col("_pieces")
    if word_end is not None:
        joined = F.rtrim(F.replace(joined, F.lit(word_end), F.lit(" ")))
    return piece_lists.withColumn(name, joined).drop("_pieces")


# -- byte-pair encoding ------------------------------------------------------------


def _word_pieces(word: str, ranks: dict[tuple[str, str], int], word_end: str) -> list[str]:
    """Split one word: merge the leftmost pair of the lowest rank while there is one.

    Pairs wait in a heap by (rank, place) and pieces know their neighbours, so
    a word of n characters takes n log n steps. A pair that has changed since
    it was put in is skipped.
    """
    pieces: list[str | None] = [*word[:-1], word[-1] + word_end]
    n = len(pieces)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(ranks[pair], at) for at, pair in enumerate(zip(pieces, pieces[1:])) if pair in ranks]
    heapify(waiting)
    while waiting:
        rank, at = heappop(waiting)
        gone = after[at]
        if gone == n or ranks.get((pieces[at], pieces[gone])) != rank:
            continue
        pieces[at], pieces[gone] = pieces[at] + pieces[gone], None
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        for left in (before[at], at):
            if left >= 0 and after[left] < n:
                pair = pieces[left], pieces[after[left]]
                if pair in ranks:
                    heappush(waiting, (ranks[pair], left))
    return [p for p in pieces if p is not None]


def _merge_ranks(merges: DataFrame) -> dict[tuple[str, str], int]:
    """Rank of each pair, counted from 0; a pair learnt twice keeps its first one."""
    rows = lookup_rows(merges.select("rank", "left", "right"))
    if rows is None:
        raise ValueError(f"more than {MAX_LOOKUP} merges: not a byte-pair vocabulary of this library")
    pairs = dict.fromkeys((r.left, r.right) for r in sorted(rows, key=lambda r: r["rank"]))
    return {pair: i for i, pair in enumerate(pairs)}


def word_lexicon(words: DataFrame, merges: DataFrame, word: str = "word", word_end: str = "</w>") -> DataFrame:
    """``(word, pieces)``: every distinct word split by the merges, once."""
    ranks = words.sparkSession.sparkContext.broadcast(_merge_ranks(merges))

    @F.pandas_udf(PIECES)
    def split(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: _word_pieces(w, ranks.value, word_end))

    return words.select(word).distinct().select(word, split(F.col(word)).alias("pieces"))


def encode(
    df: DataFrame,
    words: Column,
    merges: DataFrame,
    vocab: DataFrame,
    name: str = "ids",
    unk_id: int = UNK_ID,
    bos: int | None = None,
    eos: int | None = None,
    word_end: str = "</w>",
) -> DataFrame:
    """Byte-pair ids of the words of each row.

    Merges and vocabulary are bounded by the trained size and go to the tasks
    once; a task splits each word it meets once and remembers it. Nothing is
    shuffled, so hot words and long texts cost no more than any other.
    """
    rows = lookup_rows(vocab.select("token", "id", "is_special"))
    if rows is None:
        raise ValueError(f"more than {MAX_LOOKUP} tokens: not a byte-pair vocabulary of this library")
    learnt = {r.token: r.id for r in rows if not r.is_special}
    special = {r.token: [r.id] for r in rows if r.is_special}
    model = df.sparkSession.sparkContext.broadcast((_merge_ranks(merges), learnt, special))

    known: dict[str, list[int]] = {}  # in a task: the words it has split

    @F.arrow_udf(IDS)
    def encode_batches(batch: pa.Array) -> pa.Array:
        ranks, ids, whole = model.value

        def word_ids(word: str) -> list[int]:
            found = whole.get(word) or known.get(word)
            if found is None:
                if len(known) >= _CACHE:
                    known.clear()
                found = known[word] = [ids.get(p, unk_id) for p in _word_pieces(word, ranks, word_end)]
            return found

        def coded(lists: pa.Array) -> pa.Array:
            items = lists.flatten().dictionary_encode()
            own = [word_ids(w.as_py()) for w in items.dictionary]
            size = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter(chain.from_iterable(own), np.int32, int(size.sum()))
            which = items.indices.to_numpy(zero_copy_only=False)
            before = np.concatenate(([0], np.cumsum(size[which])))
            shift = (np.cumsum(size) - size)[which] - before[:-1]
            return _laid_out(lists, pa.array(flat[np.arange(before[-1]) + np.repeat(shift, size[which])]), before)

        return _in_runs(batch, coded, pa.list_(pa.int32()))

    out = df.withColumn(name, encode_batches(words))
    return with_ends(out, name, bos, eos)


def with_ends(df: DataFrame, name: str, bos: int | None, eos: int | None) -> DataFrame:
    """Optional begin and end ids around an id column."""
    parts = []
    if bos is not None:
        parts.append(F.array(F.lit(bos)))
    parts.append(F.col(name))
    if eos is not None:
        parts.append(F.array(F.lit(eos)))
    return df.withColumn(name, F.concat(*parts)) if len(parts) > 1 else df


def words_with_specials(text: Column, specials: list[str], pattern: str) -> Column:
    """Words of a text in which special tokens stand as words of their own."""
    any_special = "|".join(re.escape(s) for s in specials)
    return F.regexp_extract_all(text, F.lit(f"{any_special}|{pattern}"), F.lit(0))


def pieces_of(df: DataFrame, ids: Column, vocab: DataFrame, key: list[str], piece: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each token on its own: ``(key, pos, id, piece)``."""
    single = df.select(*key, F.posexplode(ids).alias("pos", "id"))
    shown = decode(single, F.array("id"), vocab, [*key, "pos"], "piece")
    return shown.withColumn("piece", piece(F.col("piece"))) if piece else shown
