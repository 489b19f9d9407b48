"""Splits, batches and resume points over numbered rows.

Positions come from an explicit order (``plans.grouped``), never from file
order, so a split is the same however the table is partitioned. Windows are
numbered as they are packed (``pack.pack`` with ``numbered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import HASH_BITS, hash60
from textloom.plans.grouped import positions, row_numbers


def head_size(n: Column, ratio: float = 0.9) -> Column:
    """Rows of the head split: ``ratio`` of the count, rounded down."""
    return F.floor(n * F.lit(ratio)).cast("bigint")


def number_rows(
    df: DataFrame, order: str | Sequence[str], name: str = "rn", total: str = "n_rows", any_key: bool = False
) -> DataFrame:
    """Dense 0-based position, and the row count, along a unique order.

    That is a dense integer, or with ``any_key`` columns of any type.
    """
    order = [order] if isinstance(order, str) else list(order)
    return positions(df, [], order, name, total) if any_key else row_numbers(df, [], order, name, total=total)


def positional_split(df: DataFrame, ratio: float = 0.9, rn: str = "rn", total: str = "n_rows") -> DataFrame:
    """Label the head ``train`` and the tail ``test``."""
    head = F.col(rn) < head_size(F.col(total), ratio)
    return df.withColumn("split", F.when(head, "train").otherwise("test"))


def reconcile(parts: DataFrame, total: DataFrame) -> DataFrame:
    """Rows per split and in all; fails the job when they do not add up."""
    both = parts.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
    ).withColumn("n_total", total.agg(F.count("*")).scalar())
    agree = F.col("n_train") + F.col("n_test") == F.col("n_total")
    wrong = F.raise_error(F.lit("splits do not add up to the table")).cast("boolean")
    return both.select("*", F.when(agree, F.lit(True)).otherwise(wrong).alias("agrees"))


def hash_split(df: DataFrame, key: Sequence[str], ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """Random split by a seeded hash of the key: stable under repartitioning."""
    million = 1_000_000
    train = F.pmod(hash60(*key, seed=seed), F.lit(million)) < int(ratio * million)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def shuffled_numbers(
    df: DataFrame, key: Sequence[str], seed: int = 42, name: str = "rn", bucket_bits: int = 16
) -> DataFrame:
    """Position of each row in a seeded random order of the whole table.

    Rows are ordered in ``2 ** bucket_bits`` even buckets of the hash.
    """
    hashed = df.withColumn("_h", hash60(*key, seed=seed))
    bucket = F.shiftright("_h", HASH_BITS - bucket_bits)
    out = row_numbers(hashed, [], ["_h", *key], name, bucket=bucket, total="n_rows")
    return out.drop("_h")


def split_text(df: DataFrame, text: str = "text", ratio: float = 0.9) -> DataFrame:
    """Head and tail of each text, cut at ``ratio`` of its characters."""
    cut = F.floor(F.length(text) * F.lit(ratio)).cast("int")
    return df.select(
        "*", F.substr(text, F.lit(1), cut).alias("train_text"), F.substr(text, cut + 1).alias("test_text")
    )


def batches(df: DataFrame, batch_size: int, drop_last: bool = True, rn: str = "rn", total: str = "n_rows") -> DataFrame:
    """Add ``batch_id``; a short last batch is dropped unless told otherwise."""
    out = df.withColumn("batch_id", F.floor(F.col(rn) / batch_size).cast("bigint"))
    return out.where(F.col("batch_id") < n_batches(F.col(total), batch_size)) if drop_last else out


def n_batches(n_rows: Column, batch_size: int) -> Column:
    """Full batches in a table: the loader's length."""
    return F.floor(n_rows / batch_size).cast("bigint")


def collate(
    df: DataFrame, columns: Sequence[str] = ("input_ids", "target_ids"), rn: str = "rn", by: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """One row per batch: the rows' arrays stacked in order.

    A batch has at most ``batch_size`` rows. Arrays of unequal length fail.
    """
    rows = F.array_sort(F.collect_list(F.struct(rn, *columns)))
    stacked = df.groupBy(*by).agg(rows.alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in columns])
    for c in columns:
        sizes = F.transform(c, lambda ids: F.size(ids))
        even = F.array_max(sizes) == F.array_min(sizes)
        wrong = F.raise_error(F.lit(f"{c}: arrays of a batch differ in length"))
        stacked = stacked.withColumn(c, F.when(even, F.col(c)).otherwise(wrong.cast("array<array<int>>")))
    return stacked


def resume(df: DataFrame, global_step: int, len_loader: int) -> DataFrame:
    """Batches still to do in the epoch that ``global_step`` had reached."""
    return df.where(F.col("batch_id") >= global_step % len_loader) if global_step else df


def repeat_epochs(df: DataFrame, n_epochs: int, len_loader: Column) -> DataFrame:
    """Every batch once per epoch, with its global step."""
    epochs = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    return epochs.withColumn("step", F.col("epoch") * len_loader + F.col("batch_id"))
