"""Running totals, group totals and cut-offs without a hot group in one task.

``Window.partitionBy(group)`` sends a group to one task. That is right for the
usual group and wrong for one that holds a third of all rows, so ``find_hot``
looks for hot groups first: one job, a map-side combined count that reads only
the group columns.

* Without hot groups every operation is a plain window: one shuffle by group,
  and none at all when the rows are already partitioned by it.
* With hot groups these are cut into buckets. Rows are shuffled by (group,
  bucket), and what a bucket must know of the rest of its group is joined back
  from a small table. The marked rows are written once, as both sides of that
  join read them.

Where order matters, buckets are ranges of the order columns. ``in_ranges``
samples them, so keys of any type and spread give even ranges. ``key_bucket``
is the cheaper cut for integers known to be dense, such as row numbers.

A group is hot above ``HOT_ROWS`` rows, at any size of the table. Up to
``HOT_PARTS`` hot groups travel to the tasks; more are written as a table and
joined.

Group columns must not be null. Where groups are cut, a null in a group column
or in the first order column fails the job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.shared_dir import materialise

HOT_ROWS = 1_000_000
HOT_PARTS = 100_000  # hot groups that may go to every task

KEYS_PER_BUCKET = 1 << 16  # key range of a bucket: at most this many rows, keys being unique
BUCKETS_PER_RANGE = 1 << 12  # buckets per second-level range
ROWS_PER_SALT = 1 << 18  # aimed rows per bucket where order does not matter
ROWS_PER_RANGE = 1 << 18  # aimed rows of a sampled range; none has more than twice as many
_DEALS = 8  # times the ranges may be halved to reach that


@dataclass(frozen=True)
class HotGroups:
    """The hot groups of a table: ``(group.., _hot)`` rows with their size, or None."""

    group: tuple[str, ...]
    table: DataFrame | None
    few: bool = True

    def sent(self, per_group: DataFrame) -> DataFrame:
        """A table of one row per hot group, to be joined: broadcast if they are few."""
        return F.broadcast(per_group) if self.few else per_group

    def mark(self, df: DataFrame) -> DataFrame:
        """Add ``_hot``, null for usual groups, and write the rows once."""
        marked = df.drop("_hot").join(self.sent(self.table), list(self.group), "left")
        return materialise(marked.select(*df.columns, "_hot"), "marked")


def find_hot(df: DataFrame, group: Sequence[str]) -> HotGroups:
    """Look for hot groups (runs a job)."""
    counts = df.groupBy(*group).agg(F.count("*").alias("_hot"))
    large = counts.where(F.col("_hot") > HOT_ROWS)
    rows = large.limit(HOT_PARTS + 1).collect()
    if len(rows) > HOT_PARTS:
        return HotGroups(tuple(group), materialise(large, "hot-groups"), few=False)
    table = df.sparkSession.createDataFrame(rows, large.schema) if rows else None
    return HotGroups(tuple(group), table)


def key_bucket(key: str | Column, width: int | None = None) -> Column:
    """Range of an integer key; ``width`` is a power of two."""
    return F.shiftright(key, (width or KEYS_PER_BUCKET).bit_length() - 1)


def required(column: str) -> Column:
    """The column itself; a null fails the job."""
    fails = F.raise_error(F.lit(f"{column} must not be null"))
    return F.when(F.col(column).isNull(), fails).otherwise(F.col(column)).alias(column)


def in_ranges(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame:
    """Deal the rows out by ranges of ``order``, write them and add the number of the range.

    Range numbers do not decrease along ``order``, and equal keys share a
    range. Spark samples the limits of the ranges; then the rows of each range
    are counted. While one has more than twice ``ROWS_PER_RANGE`` rows, the
    table is dealt out again into twice as many. Keys that repeat so often that
    no limits can part them fail. ``df`` is read several times.
    """
    n = max(1, math.ceil(df.count() / ROWS_PER_RANGE))
    for _ in range(_DEALS):
        dealt = df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id().cast("bigint"))
        dealt = materialise(dealt, "ranges")
        largest = dealt.groupBy(name).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= 2 * ROWS_PER_RANGE:
            return dealt
        n *= 2
    raise ValueError(f"{', '.join(order)}: {largest} rows share a range, keys repeat too often")


def _salt(column: str) -> Column:
    """Order-free bucket of a marked row; usual groups have one bucket."""
    n = F.ceil(F.col("_hot") / F.lit(ROWS_PER_SALT)).cast("bigint")
    return F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(column), n))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    bucket: Column | None = None,
    totals: Mapping[str, str] | None = None,
    hot: HotGroups | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add, per value, its sum over the rows of the group that come earlier.

    ``values`` maps an output column to the summed expression; the sum excludes
    the row itself. ``totals`` maps further output columns to a value name and
    adds the sum over the whole group. The order columns are of any type and
    unique in their group.

    With ``bucket`` all groups are cut, by a bucket that does not decrease
    along ``order``: for groups known to be large. Without groups the whole
    table is cut, by its first order column, a dense integer. ``carried`` holds
    further columns of each group, to be added with those of its buckets.
    """
    group, totals, names = list(group), dict(totals or {}), list(values)
    cut_all = bucket is not None or not group
    if not cut_all:
        hot = hot or find_hot(df, group)
        if hot.table is not None:
            return _hot_and_usual(df, group, order, values, totals, hot)
    if cut_all:
        checked = {c: required(c) for c in [*group, order[0]]}
        keyed = df.select(*[checked.get(c, F.col(c)) for c in df.columns])
        keyed = keyed.withColumn("_b", key_bucket(order[0]) if bucket is None else bucket)
    else:
        keyed = df.withColumn("_b", F.lit(0).cast("bigint"))
    keyed = keyed.select("*", *[values[n].alias(f"_v_{n}") for n in names])

    together = Window.partitionBy(*group, "_b") if cut_all else Window.partitionBy(*group)
    before = together.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = [F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_in_{n}") for n in names]
    of_group = [] if cut_all else [F.sum(f"_v_{v}").over(together).alias(f"_all_{c}") for c, v in totals.items()]
    rows = keyed.select(*df.columns, "_b", *in_bucket, *of_group)
    if not cut_all:
        return rows.select(
            *df.columns, *[F.col(f"_in_{n}").alias(n) for n in names], *[F.col(f"_all_{c}").alias(c) for c in totals]
        )

    offsets = _bucket_offsets(keyed, group, names, totals)
    added = []
    if carried is not None:
        added = [c for c in carried.columns if c not in group]
        offsets = offsets.join(carried, group)
    # rows already lie by (group, bucket); the hint keeps them there on small data too
    joined = rows.join(offsets.hint("shuffle_hash"), [*group, "_b"])
    return joined.select(
        *[joined[c] for c in df.columns],
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in names],
        *[F.col(f"_sum_{c}").alias(c) for c in totals],
        *added,
    )


def _hot_and_usual(df, group, order, values, totals, hot: HotGroups) -> DataFrame:
    """``running_totals`` of usual groups by plain windows, of hot ones by sampled ranges."""
    marked = hot.mark(df)
    usual = marked.where("_hot IS NULL").drop("_hot")
    usual = running_totals(usual, group, order, values, totals=totals, hot=HotGroups(hot.group, None))
    large = in_ranges(marked.where("_hot IS NOT NULL").drop("_hot"), [*group, *order])
    large = running_totals(large, group, order, values, F.col("_range"), totals)
    return usual.unionByName(large.drop("_range"))


def totals_by_range(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """``running_totals`` along keys of any type and spread, for groups of any size.

    The table is cut into sampled ranges of (group, order): hashed 64-bit
    integers, texts or decimals number as evenly as dense row numbers do, and a
    group of a third of all rows lies in many ranges. A null key fails the job,
    and so does a key that repeats in its group. The rows are written once with
    their range, so hand over the key and value columns only.
    """
    keys = [*group, *order]
    rows = in_ranges(df.select(*[required(c) if c in keys else F.col(c) for c in df.columns]), keys)
    # equal keys share a range, so a repeated one stands next to its double there
    earlier = F.lag(F.struct(*order)).over(Window.partitionBy(*group, "_range").orderBy(*order))
    repeats = F.raise_error(F.lit(f"{', '.join(keys)}: a key repeats"))
    first = F.when(earlier == F.struct(*order), repeats).otherwise(F.col(order[0])).alias(order[0])
    rows = rows.select(*[first if c == order[0] else F.col(c) for c in rows.columns])
    out = running_totals(rows, group, order, values, F.col("_range"), totals, carried=carried)
    return out.drop("_range")


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rn", total: str | None = None) -> DataFrame:
    """Dense 0-based position inside the group along keys of any type, see ``totals_by_range``."""
    return totals_by_range(df, group, order, {name: F.lit(1).cast("bigint")}, {total: name} if total else None)


def _bucket_offsets(keyed: DataFrame, group: list[str], names: list[str], totals: Mapping[str, str]) -> DataFrame:
    """``(group.., _b, _off_.., _sum_..)``: totals before each bucket and of its group.

    Buckets are summed over ranges of buckets first, so the window that sees a
    whole group holds one row per ``BUCKETS_PER_RANGE`` buckets. The result has
    one row per bucket and no size bound, hence no broadcast hint.
    """
    sums = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names]
    in_range = key_bucket("_b", BUCKETS_PER_RANGE)
    buckets = keyed.groupBy(*group, "_b").agg(*sums).withColumn("_r", in_range)
    ranges = keyed.groupBy(*group, in_range.alias("_r")).agg(*sums)

    whole = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *group,
        "_r",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_up_{n}") for n in names],
        *[F.sum(f"_s_{v}").over(whole).alias(f"_sum_{c}") for c, v in totals.items()],
    )
    inside = Window.partitionBy(*group, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *group, "_b", "_r", *[F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0)).alias(f"_mid_{n}") for n in names]
    )
    return buckets.join(ranges, [*group, "_r"]).select(
        *group,
        "_b",
        *[(F.col(f"_mid_{n}") + F.col(f"_up_{n}")).alias(f"_off_{n}") for n in names],
        *[f"_sum_{c}" for c in totals],
    )


def row_numbers(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    bucket: Column | None = None,
    total: str | None = None,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Dense 0-based position inside the group, optionally with the group size."""
    one = {name: F.lit(1).cast("bigint")}
    return running_totals(df, group, order, one, bucket, {total: name} if total else None, hot)


def group_values(
    df: DataFrame, hot: HotGroups, spread_by: str, aggs: Mapping[str, tuple[Callable[..., Column], str]]
) -> DataFrame:
    """Add aggregates of the whole group to each of its rows.

    ``aggs`` maps an output column to ``(function, column)``. ``spread_by`` is a
    column with many values in a group; it spreads the rows of a hot one.
    """
    group = list(hot.group)
    if hot.table is None:
        together = Window.partitionBy(*group)
        return df.select("*", *[f(c).over(together).alias(n) for n, (f, c) in aggs.items()])
    marked = hot.mark(df)
    together = Window.partitionBy(*group, "_b")
    rows = marked.withColumn("_b", _salt(spread_by))
    rows = rows.select("*", *[f(c).over(together).alias(f"_local_{n}") for n, (f, c) in aggs.items()])
    # one row per hot group
    whole = marked.where("_hot IS NOT NULL").groupBy(*group).agg(*[f(c).alias(f"_whole_{n}") for n, (f, c) in aggs.items()])
    joined = rows.join(hot.sent(whole), group, "left")
    return joined.select(*df.columns, *[F.coalesce(f"_whole_{n}", f"_local_{n}").alias(n) for n in aggs])


def best_keys(df: DataFrame, group: Sequence[str], key: Column, k: int, spread_by: str | None = None) -> DataFrame:
    """``(group.., _k, _r)``: the ``k`` largest keys of each group, ``_r`` counting them from 1.

    ``row_number() <= k`` is a limit per group that Spark applies before the
    shuffle too, so a task sends ``k`` rows of a group at most. ``spread_by``
    cuts groups into buckets first, for a ``k`` as large as a bucket.
    """
    group = list(group)
    rows = df.select(*group, key.alias("_k"), *([F.pmod(F.xxhash64(spread_by), F.lit(_BUCKETS)).alias("_b")] if spread_by else []))
    if spread_by:
        inside = Window.partitionBy(*group, "_b").orderBy(F.desc("_k"))
        rows = rows.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k).select(*group, "_k")
    whole = Window.partitionBy(*group).orderBy(F.desc("_k"))
    return rows.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k)


_BUCKETS = 64
LARGE_K = 1 << 16  # rows of a group's limit that one task may order


def group_cutoff(df: DataFrame, group: Sequence[str], spread_by: str, key: Column, k: int, name: str = "cutoff") -> DataFrame:
    """Add the ``k``-th largest key of the group (the smallest one if fewer).

    ``key >= cutoff`` keeps exactly ``k`` rows when keys are unique, and all
    ties at the line when they are not. No group is sorted: of each only its
    best ``k`` keys are dealt out, and the line is joined back by group. The
    line has one row per group, hence no broadcast hint; groups must not be null.
    """
    group = list(group)
    best = best_keys(df, group, key, k, spread_by if k > LARGE_K else None)
    line = best.groupBy(*group).agg(F.min("_k").alias(name))
    return df.join(line, group).select(*df.columns, name)
