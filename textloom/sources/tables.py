"""Parquet and CSV scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_splits(spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Parquet files per split, one after the other, with a ``split`` column.

    ``columns`` names the columns of a split to read, in common order, when the
    files do not agree on names; the first split gives the names.
    """
    out, names = None, None
    for split, path in paths.items():
        df = spark.read.parquet(path)
        if columns:
            df = df.select(*columns[split])
            names = names or df.columns
            df = df.toDF(*names)
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


SMALL_TABLE = 1 << 30  # bytes


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table too small to fill them with its files.

    Cleaning text is much work per byte, and a small file is one scan task. A
    table with fewer files than cores, and up to ``SMALL_TABLE`` bytes in them,
    is dealt out by key; any other keeps the tasks of its scan.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]  # reads no content
    return df.repartition(cores, key) if size <= SMALL_TABLE else df


def sql_over_file(spark: SparkSession, path: str, query: str, view: str = "data") -> DataFrame:
    """SQL over a parquet file that the query calls ``view``; the session's own views stay as they are."""
    file = path.replace("`", "``")
    return spark.sql(f"WITH {view} AS (SELECT * FROM parquet.`{file}`) SELECT * FROM ({query})")


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Quoted CSV with line breaks and fields of any size; only ``columns`` are parsed. A row that does not fit fails."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("sep", sep)
    reader = reader.option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
    reader = reader.option("lineSep", "\n").option("mode", "FAILFAST")
    return reader.csv(path).select(*columns)


_WIDER = {"int": "bigint", "bigint": "double"}  # any other type: string


def scan_csv_inferred(spark: SparkSession, path: str, sep: str = ",", sample: float = 1.0) -> DataFrame:
    """CSV whose types are inferred from a share of its rows, and widened where a row of the rest does not fit.

    All rows are read once with the inferred types. A column with a value that
    its type cannot hold gets the next wider one (int, bigint, double, string;
    any other type: string), until all values fit, so at most three more reads
    follow. No row is lost. A row with more or fewer fields than the header
    fails.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    types = dict(reader.option("inferSchema", True).option("samplingRatio", sample).csv(path).dtypes)
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    schema = lambda kinds: T.StructType([T.StructField(c, T.StringType() if t == "string" else T.DataType.fromDDL(t)) for c, t in kinds.items()])
    record = "_record"
    while record in types:
        record += "_"
    texts = ", ".join(f"c{i} string" for i in range(len(types)))
    while any(t != "string" for t in types.values()):
        whole = T.StructType([*schema(types), T.StructField(record, T.StringType())])
        rows = reader.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record).csv(path)
        text = F.from_csv(F.col(record), texts, {"sep": sep, "escape": '"'})
        misses = [F.coalesce(F.bool_or(F.col(f"`{c}`").isNull() & text[f"c{i}"].isNotNull()), F.lit(False)).alias(f"m{i}") for i, c in enumerate(types)]
        missed = [c for c, m in zip(types, rows.agg(*misses).first(), strict=True) if m and types[c] != "string"]
        if not missed:
            break
        types.update({c: _WIDER.get(types[c], "string") for c in missed})
    return reader.schema(schema(types)).option("mode", "FAILFAST").csv(path)


def non_empty(*cols: str) -> Column:
    """All columns present and not empty."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & (F.col(c) != "")
    return out


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """Preview: the first ``n`` rows along ``order``."""
    return df.orderBy(order).limit(n)


def first_chars(text: Column, n: int = 1000) -> Column:
    return F.substring(text, 1, n)
