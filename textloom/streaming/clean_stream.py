"""Clean newly arrived files and append them to the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_new_files(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream.

    ``pattern`` names entries of the folder: files, or tables that are folders
    of files themselves.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path.rstrip('/')}/{{{pattern}}}" if pattern else path)  # in braces any name is a glob


def append_cleaned(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Run ``transform`` on all files not seen before and append the result.

    The checkpoint remembers the files, so a restart neither loses nor repeats
    one. The same ``transform`` serves a batch table.
    """
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
