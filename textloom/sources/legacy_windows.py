"""Windows stored as one string column named ``input_ids,target_ids``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEGACY_COLUMN = "input_ids,target_ids"


def _parse(part: Column) -> Column:
    return F.from_json(F.replace(part, F.lit('"'), F.lit("")), "array<int>")


def parse_legacy(df: DataFrame, column: str = LEGACY_COLUMN) -> DataFrame:
    """Replace the string ``"[..]","[..]"`` by two id arrays."""
    parts = F.split(F.col(f"`{column}`"), '",')
    others = [c for c in df.columns if c != column]
    return df.select(
        *[F.col(f"`{c}`") for c in others],
        _parse(F.get(parts, F.lit(0))).alias("input_ids"),
        _parse(F.get(parts, F.lit(1))).alias("target_ids"),
    )


def printed_ids(ids: Column) -> Column:
    """An id array as a printed list: ``[1, 2]``."""
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def to_legacy(df: DataFrame) -> DataFrame:
    """Windows in the one-column form."""
    both = [F.concat(F.lit('"'), printed_ids(F.col(c)), F.lit('"')) for c in ("input_ids", "target_ids")]
    others = [c for c in df.columns if c not in ("input_ids", "target_ids")]
    return df.select(*others, F.concat_ws(",", *both).alias(LEGACY_COLUMN))
