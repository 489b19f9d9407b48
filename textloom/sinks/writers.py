"""Writers. All write folders of part files, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import END_OF_TEXT, minimal_csv_quoting, with_suffix


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """All rows as CSV with a header; quotes are doubled."""
    writer = df.write.option("header", True).option("sep", sep).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def corpus_lines(df: DataFrame, text: str = "text", suffix: str = " " + END_OF_TEXT, quoting: str | None = None):
    """The output line of each article; ``quoting="pandas"`` prints it as a CSV field."""
    line = with_suffix(F.col(text), suffix)
    return minimal_csv_quoting(line) if quoting == "pandas" else line


def write_corpus(
    df: DataFrame, path: str, stream: str, order: str, text: str = "text", suffix: str = " " + END_OF_TEXT,
    quoting: str | None = None,
) -> None:
    """Articles as text lines, one folder per stream, in order.

    Rows are range-partitioned by (stream, order), so files sorted by name hold
    a stream in order and a large stream is spread over many files.
    """
    lines = df.select(stream, order, corpus_lines(df, text, suffix, quoting).alias("value"))
    ordered = lines.repartitionByRange(stream, order).sortWithinPartitions(stream, order)
    ordered.select(stream, "value").write.partitionBy(stream).text(path)


def append_table(df: DataFrame, path: str) -> None:
    """Create a parquet table, or append to the one that is there."""
    df.write.mode("append").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so reading a split skips the others."""
    df.write.option("compression", "snappy").partitionBy("split").parquet(path)


def csv_to_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "snappy").parquet(path)


def save_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """Vocabulary and merges as two tables."""
    vocab.write.parquet(f"{path}/vocab")
    merges.write.parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
