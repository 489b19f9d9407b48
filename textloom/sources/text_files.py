"""Text files by line, in file order, and as whole strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.plans.shared_dir import materialise


SENT_BLOCKS = 1_000_000  # file blocks whose line counts may go to every task; about 200 MB at most


def scan_lines(spark: SparkSession, path: str, partitions: Sequence[str] = ()) -> DataFrame:
    """``(file, line, text)``: stripped lines with their 0-based number in the file.

    ``partitions`` names directory columns to keep. See ``_numbered`` for how
    lines are counted.
    """
    return _numbered(spark, path, partitions, ["file"]).select(*partitions, "file", "line", "text")


def scan_stream_lines(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """``(stream, line, text)``: lines numbered through all files of a stream.

    A stream is a directory column; its files follow one another by name, as
    ``sinks.write_corpus`` leaves them.
    """
    return _numbered(spark, path, [stream], [stream]).select(stream, "line", "text")


def _numbered(spark: SparkSession, path: str, partitions: Sequence[str], whole: Sequence[str]) -> DataFrame:
    """Lines with their number in all blocks of ``whole``, in the order of files and blocks.

    A file is read in blocks, each by one task and in order, so row ids rise by
    one inside a block. A line's number is the lines of earlier blocks plus its
    id less the first id of its block. Only the counts and first ids of blocks
    are shuffled, written and, up to ``SENT_BLOCKS`` of them, sent to the tasks
    of the scan; more are joined. Texts stay in the tasks that read them. If
    the files change or are cut in other blocks in between, the job fails.
    """
    rows = spark.read.text(path).select(
        *partitions,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    place = [*partitions, "file", "_block"]
    blocks = materialise(rows.groupBy(*place).agg(F.count("*").alias("_n"), F.min("_id").alias("_first")), "blocks")
    earlier = Window.partitionBy(*whole).orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    counted = materialise(blocks.select("file", "_block", "_n", "_first", before), "block-lines")
    if blocks.count() <= SENT_BLOCKS:
        counted = F.broadcast(counted)
    joined = rows.join(counted, ["file", "_block"], "left")
    at = F.col("_id") - F.col("_first")
    moved = F.raise_error(F.lit("the files changed while their lines were numbered"))
    line = F.when((at >= 0) & (at < F.col("_n")), F.col("_before") + at).otherwise(moved)
    return joined.select(*partitions, "file", line.alias("line"), strip(F.col("value")).alias("text"))


def scan_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)``: one row per file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
