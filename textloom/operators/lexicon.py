"""Looking up the items of arrays in a table of any size.

Rows are cut into pieces of at most ``PIECE`` items, and pieces that a task
reads one after the other form chunks of about ``CHUNK`` items. What is looked
up is the distinct items of each chunk, by a join with the table; then each
chunk meets its own small lexicon again, and all its items are found at once in
Arrow. Rows move once, and of the items only those that are new to a chunk.

The items of the ``FREQUENT`` first ids may stand in every chunk, so these are
sent to the tasks; any other item is in the join once per chunk that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.shared_dir import materialise

PIECE = 1 << 14  # items
CHUNK = 1 << 20  # items
FREQUENT = 1024  # ids whose items are sent to every task
_ROWS_OF_TASK = 33  # bits


def _cut(piece: int, chunk: int, names: list[str]):
    """Pieces of the rows of a task, with their chunk; columns of the row stay with its first piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << _ROWS_OF_TASK
        rows, items = 0, 0
        for batch in batches:
            lists = batch.column("_items")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.maximum(1, -(-sizes // piece))  # pieces of each row
            owner = np.repeat(np.arange(len(sizes)), n)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(piece, sizes[owner] - part * piece)
            ends = np.cumsum(length)
            parts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), n, 0)[owner]
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            columns = [
                pa.array(task + rows + owner), pa.array(part.astype(np.int32)), pa.array(parts.astype(np.int32)),
                pa.array(task + (items + ends - length) // chunk), pa.ListArray.from_arrays(offsets, lists.flatten()),
            ]
            first = pa.array(owner, mask=part > 0)
            columns += [batch.column(c).take(first) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_part", "_parts", "_chunk", "_items", *names])
            rows, items = rows + len(sizes), items + int(ends[-1]) if len(ends) else items

    return work


def _found(names: list[str], required: bool):
    """The values of a chunk's items, from the chunk's lexicon."""

    def work(pieces: pa.Table, lexicon: pa.Table) -> pa.Table:
        lists = pieces.column("_items").combine_chunks()
        items, known = lists.flatten(), lexicon.column("item").combine_chunks()
        at = pc.index_in(items, value_set=known)
        if required and at.null_count:
            raise ValueError(f"not in vocabulary: {items.filter(at.is_null())[0].as_py()}")
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lexicon.column("value").combine_chunks().take(at))
        kept = ["_row", "_part", "_parts"]
        return pa.table([*[pieces.column(c) for c in kept], values, *[pieces.column(c) for c in names]], names=[*kept, "_values", *names])

    return work


def look_up(
    df: DataFrame, items: Column, table: DataFrame, item: str, value: str, name: str,
    required: bool = False, piece: int = PIECE, chunk: int = CHUNK,
) -> DataFrame:
    """``df`` with an array ``name``: the ``value`` of each item in ``table(token, id)``.

    ``item`` and ``value`` are its columns, one each, both unique in it. An item
    that is not in the table gives a null or, if ``required``, fails the job. A
    null array stays null, an empty one empty; rows may repeat, as may columns
    of any name. Empty in, empty out. A chunk and its lexicon are what a task
    holds: ``chunk`` items and one piece more at most. ``df`` is read once.
    """
    kept = [c for c in df.columns if c != name]
    names = [f"c{i}" for i in range(len(kept))]
    source = df.select(items.alias("_items"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    place = [T.StructField("_row", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_parts", T.IntegerType())]
    cut = T.StructType([*place, T.StructField("_chunk", T.LongType()), T.StructField("_items", source.schema["_items"].dataType), *[source.schema[n] for n in names]])
    pieces = materialise(source.mapInArrow(_cut(piece, chunk, names), cut), "pieces")
    carried = [pieces.schema[n] for n in names]  # as read back: arrays may hold nulls there

    known = materialise(table.select(F.col(item).alias("item"), F.col(value).alias("value"), (F.col("id") < FREQUENT).alias("frequent")), "known")
    wanted = pieces.select("_chunk", F.explode("_items").alias("item")).distinct()
    sent = F.broadcast(known.where("frequent").select("item", "value"))  # FREQUENT rows at most: ids are unique
    wanted = materialise(wanted.join(sent, "item", "left"), "chunk-items")
    rest = wanted.where("value IS NULL").select("_chunk", "item").join(known.where("NOT frequent").select("item", "value"), "item")
    lexicon = wanted.where("value IS NOT NULL").select("_chunk", "item", "value").unionByName(rest)

    values = T.StructField("_values", T.ArrayType(known.schema["value"].dataType))
    both = pieces.groupBy("_chunk").cogroup(lexicon.groupBy("_chunk"))
    coded = both.applyInArrow(_found(names, required), T.StructType([*place, values, *carried]))
    result = F.when(F.col("_parts") > 0, F.col("_values")).alias(name)
    columns = [F.col(n).alias(c) for c, n in zip(kept, names, strict=True)]
    if not pieces.where("_parts > 1").limit(1).count():
        return coded.select(*columns, result)
    coded = materialise(coded, "coded")
    long = coded.where("_parts > 1").groupBy("_row").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("_part", "_values")))["_values"]).alias(name),
        *[F.min_by(n, "_part").alias(n) for n in names],
    )
    return coded.where("_parts <= 1").select(*columns, result).unionByName(long.select(*columns, name))
