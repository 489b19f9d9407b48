"""Positions of rows in a sort order, without a task that sees all rows.

Rows are dealt out by ranges of the sort key and numbered inside their range; a
range's first number is the count of rows before it. Only one small row per
range and group is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.shared_dir import materialise

_ROWS_OF_PART = 33  # bits of a row's place in its partition, in monotonically_increasing_id


def numbered(rows: DataFrame, by: list[Column], within: str | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their position (from 0) in ascending order of ``by``, per value of ``within``.

    ``by`` begins with ``within``, which holds no null. Rows equal in all of
    ``by`` are numbered in any order, and are dealt out over several ranges
    only if ``by`` tells them apart: end it with a column that does where many
    rows may be equal. The result is a stored table joined with one row per
    range and group. Empty in, empty out.
    """
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "placed").withColumn("_part", F.shiftright("_at", _ROWS_OF_PART))
    group = [within] if within else []
    counts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    order = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    joined = placed.join(counts.drop("_n"), ["_part", *group])
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
