"""Fixed-length input and target windows over token streams.

A stream (a file, a source, or one document) is the concatenation of the ids of
its rows in order. Window ``k`` starts at token ``k * stride`` and exists when
``max_length + 1`` tokens follow; its target is the same window one token on.

Rows first learn their token offset in the stream (``plans.grouped``: no task
sees a whole stream). A window that lies inside a row is cut out of it where the
row is. Of any other window each row emits the slice of its ids that falls into
it, and slices meet in ``groupBy(stream, window)``. A group holds at most ``max_length + 1`` slices whatever the size of the stream,
and tokens travel as array slices, never as one row each.

How many windows there are, and which number each has among those of all
streams, follows from token counts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.grouped import key_bucket, running_totals, totals_by_range

_ROWS_PER_BUCKET = 1 << 12  # rows of a stream numbered together; they carry their ids

MAX_LENGTH = 512
STRIDE = 384  # three quarters of the window; 512 in the later run


def n_windows(n_tokens: Column, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> Column:
    """How many windows a stream of ``n_tokens`` has."""
    spare = n_tokens - F.lit(max_length + 1)
    return F.when(spare < 0, F.lit(0).cast("bigint")).otherwise(F.floor(spare / stride).cast("bigint") + 1)


def with_sizes(df: DataFrame, ids: str = "ids", name: str = "n_ids") -> DataFrame:
    """Keep the number of ids beside them, so that counting need not read them."""
    return df.withColumn(name, F.size(ids).cast("bigint"))


def stream_offsets(
    df: DataFrame,
    stream: Sequence[str],
    order: str | Sequence[str],
    ids: str = "ids",
    n_ids: str | None = None,
    any_key: bool = False,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add ``start`` (tokens before the row) and ``n_tokens`` (of the stream).

    ``n_ids`` names a column that holds the number of ids, see ``with_sizes``.
    ``order`` is a dense integer, or with ``any_key`` columns of any type, of
    which sampled ranges are summed; then the ids stay where they are until the
    offsets are joined back. ``carried`` holds further columns of each stream.
    """
    size = F.col(n_ids) if n_ids else F.size(ids).cast("bigint")
    order = [order] if isinstance(order, str) else list(order)
    if any_key:
        keys = [*stream, *order]
        sizes = df.select(*keys, size.alias("_size"))
        placed = totals_by_range(sizes, stream, order, {"start": F.col("_size")}, {"n_tokens": "start"}, carried)
        return df.join(placed.drop("_size"), keys)
    bucket = key_bucket(order[0], _ROWS_PER_BUCKET)
    return running_totals(df, stream, order, {"start": size}, bucket, {"n_tokens": "start"}, carried=carried)


def window_bases(streams: DataFrame, stream: Sequence[str], max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """``(stream.., base, n_rows)``: windows of the streams that come earlier by name, and of all.

    ``streams`` is ``(stream.., n_tokens)``, one row per file or source, and is
    the only table that is ordered as a whole.
    """
    counts = streams.select(*stream, n_windows(F.col("n_tokens"), max_length, min(stride, max_length + 1)).alias("_n"))
    whole = Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(*stream).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint"))
    return counts.select(*stream, base.alias("base"), F.sum("_n").over(whole).alias("n_rows"))


def count_windows(df: DataFrame, stream: Sequence[str], n_ids: str, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """``(n_rows)``: windows of all streams, from their token counts; no window is built."""
    streams = df.groupBy(*stream).agg(F.sum(n_ids).alias("_n"))
    n = n_windows(F.col("_n"), max_length, min(stride, max_length + 1))
    return streams.agg(F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias("n_rows"))


def pack(
    df: DataFrame,
    stream: Sequence[str],
    order: str | Sequence[str],
    ids: str = "ids",
    max_length: int = MAX_LENGTH,
    stride: int = STRIDE,
    n_ids: str | None = None,
    any_key: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """``(stream.., win, n_tokens, input_ids, target_ids)`` for all windows.

    ``order`` is unique in its stream: a dense integer, or with ``any_key`` one
    or more columns of any type. A null stream or order fails the job. A stride
    beyond ``max_length + 1`` acts as that: the packer never drops more than it
    holds.

    ``numbered`` adds ``rn``, the position of the window when streams follow
    one another by name, and ``n_rows``, the windows of all. Both come with the
    offsets of the rows, so windows are not joined with anything.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    stride = min(stride, max_length + 1)
    order = [order] if isinstance(order, str) else list(order)
    rows = df.select(*stream, *order, ids, *([n_ids] if n_ids else []))
    bases = None
    if numbered:
        size = F.col(n_ids) if n_ids else F.size(ids).cast("bigint")
        bases = window_bases(rows.groupBy(*stream).agg(F.sum(size).alias("n_tokens")), stream, max_length, stride)
    rows = stream_offsets(rows, stream, order, ids, n_ids, any_key, bases)
    whole = ["n_tokens", "base", "n_rows"] if numbered else ["n_tokens"]
    out = _windows(rows, list(stream), whole, ids, max_length, stride)
    return out.withColumn("rn", F.col("base") + F.col("win")).drop("base") if numbered else out


def pack_rows(
    df: DataFrame, key: Sequence[str], ids: str = "ids", max_length: int = MAX_LENGTH, stride: int = STRIDE
) -> DataFrame:
    """Windows over each row on its own; a row is a whole text. No shuffle.

    A stride beyond the window skips tokens here, unlike in ``pack``.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    n = F.size(ids).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), n_windows(n, max_length, stride) - 1)
    wins = df.select(*key, ids, n.alias("n_tokens")).where(F.col("n_tokens") > max_length)
    wins = wins.select(*key, "n_tokens", ids, F.explode(starts).alias("win"))
    at = (F.col("win") * stride).cast("int")
    return wins.select(
        *key,
        "win",
        "n_tokens",
        F.slice(ids, at + 1, F.lit(max_length)).alias("input_ids"),
        F.slice(ids, at + 2, F.lit(max_length)).alias("target_ids"),
    )


def _windows(rows, stream, of_stream, ids, max_length, stride) -> DataFrame:
    """Windows of rows with ``start``; the columns ``of_stream``, ``n_tokens`` among them, are kept."""
    span = max_length + 1
    start, size = F.col("start"), F.size(ids).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((start - max_length) / stride).cast("bigint"))
    last = F.least(F.floor((start + size - 1) / stride).cast("bigint"), n_windows(F.col("n_tokens"), max_length, stride) - 1)
    touched = rows.select(*stream, ids, start.alias("_s"), *of_stream, first.alias("_first"), last.alias("_last"))
    touched = touched.where((F.size(ids) > 0) & (F.col("_first") <= F.col("_last")))
    from_, to = F.ceil(F.col("_s") / stride).cast("bigint"), F.floor((F.col("_s") + size - span) / stride).cast("bigint")
    touched = touched.withColumn("_from", from_).withColumn("_to", to)  # windows inside the row; they all exist
    inside = touched.where("_from <= _to").select(*stream, ids, "_s", *of_stream, F.explode(F.sequence("_from", "_to")).alias("win"))
    at = (F.col("win") * stride - F.col("_s")).cast("int")
    own = [F.slice(ids, at + 1 + k, F.lit(max_length)).alias(c) for k, c in enumerate(("input_ids", "target_ids"))]

    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    before, after = run(F.col("_first"), F.least(F.col("_last"), F.col("_from") - 1)), run(F.greatest(F.col("_from"), F.col("_to") + 1), F.col("_last"))
    shared = F.when(F.col("_from") <= F.col("_to"), F.concat(before, after)).otherwise(run(F.col("_first"), F.col("_last")))
    each = touched.select(*stream, ids, "_s", *of_stream, F.explode(shared).alias("win"))
    begin = F.col("win") * stride
    at = F.greatest(begin - F.col("_s"), F.lit(0))
    upto = F.least(begin + span - F.col("_s"), F.size(ids).cast("bigint"))
    parts = each.select(
        *stream,
        "win",
        *of_stream,
        F.struct(
            (F.col("_s") + at).alias("at"), F.slice(ids, (at + 1).cast("int"), (upto - at).cast("int")).alias("ids")
        ).alias("_part"),
    )
    whole = parts.groupBy(*stream, "win").agg(
        *[F.first(c).alias(c) for c in of_stream], F.flatten(F.array_sort(F.collect_list("_part"))["ids"]).alias("_w")
    )
    crossing = whole.select(
        *stream,
        "win",
        *of_stream,
        F.slice("_w", F.lit(1), F.lit(max_length)).alias("input_ids"),
        F.slice("_w", F.lit(2), F.lit(max_length)).alias("target_ids"),
    )
    return inside.select(*stream, "win", *of_stream, *own).unionByName(crossing)


def window_at(windows: DataFrame, index: int) -> DataFrame:
    """One window of each stream by its index."""
    return windows.where(F.col("win") == index)


def cap_text(text: Column, n_chars: int) -> Column:
    """The first characters of a text: a debugging aid of the trainer."""
    return F.substring(text, 1, n_chars)
