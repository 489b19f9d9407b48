"""Packing documents into sequences: first-fit decreasing in random groups.

A document's ids are cut into whole sequences and a rest. Rests are dealt into
groups at random, and each group is packed by itself: longest first, each into
the first sequence with room. A tournament tree over the sequences' free room
finds that sequence in as many steps as the tree has levels.

Groups are drawn from a row's place in the stored table of pieces, not from
its id or source, so no key makes a group large, and a rerun draws the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import texts
from textloom.llm.tokens import WordTokenizer
from textloom.plans.shared_dir import materialise

CAPACITY = 4096
END = 2
GROUP = 4096  # rests of documents


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every size (1 .. ``capacity``)."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    at, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        at[i], offset[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return at, offset


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, row = WordTokenizer.load(path), TaskContext.get().partitionId() << 33
        for rows in source:
            for words in texts.split(rows.column("text"), texts.SPACES):
                ids, begin = tokenizer.encode(words, end)
                total = np.diff(begin)
                n = -(-total // capacity)  # every document has its end, hence a piece
                doc = np.repeat(np.arange(len(n)), n)
                start = texts.ranges(np.zeros(len(n), np.int64), n) * capacity
                length = np.minimum(total[doc] - start, capacity)
                low = ids.astype("<u4")
                crc = [zlib.crc32(low[a : a + k]) for a, k in zip((begin[doc] + start).tolist(), length.tolist(), strict=True)]
                names = pc.take(rows.column("doc_id").slice(words.rows.start, len(n)), pa.array(doc))
                arrays = [names, *(pa.array(c, pa.int64()) for c in (start, length, crc, total[doc], np.arange(row, row + len(doc))))]
                row += len(doc)
                if with_ids:  # pieces lie one after the other, as the ids do
                    bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*_PIECE, *["ids"] * with_ids])

    return work


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_row"]


_PLACE = "_row bigint, sequence_id bigint, offset bigint"


def _fit(capacity: int):
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        at, frame["offset"] = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = 2 * ((key[0] << 32) + at)
        return frame[["_row", "sequence_id", "offset"]]

    return work


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their place in sequences of ``capacity`` tokens.

    Returns ``doc_id, start`` (ids of the document before the piece),
    ``length, ids_crc32`` (of the ids as little-endian 32-bit integers),
    ``doc_tokens, sequence_id, offset`` and, unless turned off, ``ids``. A
    document is its token ids and then ``end``; null and empty texts are ``end``
    alone. Each row is a document of its own, repeated or without id. A
    sequence's pieces fill it from 0 without gaps. Other columns are ignored.
    ``tokenizer`` is a file that every executor has; it must drop white space.
    Empty in, empty out.
    """
    kind = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", kind.dataType), *[T.StructField(c, T.LongType()) for c in _PIECE[1:]]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end, with_ids), schema)
    rows = materialise(rows, "pieces")
    whole = rows.where(F.col("length") == capacity)
    whole = whole.withColumn("sequence_id", 2 * F.col("_row") + 1).withColumn("offset", F.lit(0).cast("bigint"))
    rest = rows.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP))
    sizes = rest.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))
    placed = sizes.groupBy("_group").applyInPandas(_fit(capacity), _PLACE)  # token ids stay in the written pieces
    return whole.union(rest.join(placed, "_row").select(*whole.columns)).drop("_row")
