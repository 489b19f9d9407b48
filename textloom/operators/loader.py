"""Batches for a trainer: from stored windows, or straight from texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.pack import n_windows, pack_rows, with_sizes
from textloom.operators.split import batches, shuffled_numbers, split_text
from textloom.plans.grouped import running_totals
from textloom.plans.shared_dir import materialise


def window_batches(
    windows: DataFrame, batch_size: int, shuffle: bool = False, drop_last: bool = True, key: str = "rn", seed: int = 42
) -> DataFrame:
    """``windows`` numbered by ``key`` (with ``n_rows``) and a ``batch_id``.

    Shuffled or not, the position of a row depends on its key and the seed only.
    """
    if shuffle:
        others = [c for c in windows.columns if c not in ("rn", "n_rows", key)]
        numbered = shuffled_numbers(windows.select(*others, F.col(key).alias("_key")), ["_key"], seed).drop("_key")
        return batches(numbered, batch_size, drop_last)
    return batches(windows, batch_size, drop_last, rn=key)


def text_windows(df: DataFrame, key: str, max_length: int, stride: int) -> DataFrame:
    """Windows of each row's ``ids``, numbered through the table along ``key``."""
    n = n_windows(F.col("n_ids"), max_length, stride)
    based = running_totals(df.select(key, "ids", "n_ids"), [], [key], {"_base": n}, totals={"n_rows": "_base"})
    windows = pack_rows(based, [key, "_base", "n_rows"], "ids", max_length, stride)
    return windows.withColumn("rn", F.col("_base") + F.col("win")).drop("_base", "n_tokens")


def text_batches(
    df: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    key: str,
    text: str = "text",
    train_ratio: float = 0.9,
    batch_size: int = 4,
    max_length: int = 256,
    stride: int = 128,
    seed: int = 42,
) -> DataFrame:
    """Training and validation batches of texts, each text cut at ``train_ratio``.

    ``encode`` adds ``ids`` to a table with a ``text`` column. Training rows are
    shuffled and a short last batch is dropped; validation rows keep their
    order and all of them are used.
    """
    halves = split_text(df.select(key, F.col(text).alias("text")), "text", train_ratio)
    out = []
    for split, column in (("train", "train_text"), ("validation", "test_text")):
        coded = encode(halves.select(key, F.col(column).alias("text"))).select(key, "ids")
        tokens = materialise(with_sizes(coded), f"{split}-tokens")
        train = split == "train"
        rows = window_batches(text_windows(tokens, key, max_length, stride), batch_size, shuffle=train, drop_last=train, seed=seed)
        out.append(rows.withColumn("split", F.lit(split)))
    return out[0].unionByName(out[1])
