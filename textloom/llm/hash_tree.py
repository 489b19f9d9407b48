"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At each node
every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the
child's name, and the least draw wins, so a child is chosen in proportion to
its weight and independently of its siblings. Changing the weight of a subtree
changes that subtree's draws alone: rows move into it or out of it, and rows
elsewhere stay where they are. A subtree's weight is the sum of its shards'.

``grown`` adds a shard as a region of its own. Nothing but the new region's
draw is new then, so rows move only into the new shard.

Everything is DataFrame expressions. A region, rack or shard is a plan-time
name; the tree is part of the plan and bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.shared_dir import materialise

Tree = dict[str, dict[str, dict[int, float]]]

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 2


def even_tree(shards: int, per_rack: int = SHARDS_PER_RACK, per_region: int = RACKS_PER_REGION) -> Tree:
    """Region, rack and shard levels for ``shards`` shards of weight one."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}}


def _weight(node: float | dict) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _draw(key: list[Column], name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def _descend(key: list[Column], node: dict, path: str) -> Column:
    """The shard below ``node`` for the key; only the chosen subtree's draws are evaluated."""
    children = [(str(name), child) for name, child in node.items() if _weight(child) > 0]
    if not children:
        raise ValueError(f"no shard with a weight below {path or 'the root'}")
    draws = [_draw(key, f"{path}/{name}", _weight(child)) for name, child in children]
    below = [_descend(key, c, f"{path}/{n}") if isinstance(c, dict) else F.lit(int(n)) for n, c in children]
    if len(children) == 1:
        return below[0]
    least = F.least(*draws)
    out = F.when(draws[0] == least, below[0])
    for draw, shard in zip(draws[1:-1], below[1:-1], strict=True):
        out = out.when(draw == least, shard)
    return out.otherwise(below[-1])


def shard_of(tree: Tree, *key: Column) -> Column:
    """The shard of a key. A null key is a key like any other."""
    # hashing skips nulls, so a flag tells them from other values
    parts = [p for k in key for p in (k.isNull(), k)]
    return _descend(parts, tree, "").cast("int")


def place(docs: DataFrame, tree: Tree, key: str = "doc_id", next_tree: Tree | None = None) -> DataFrame:
    """Every row's shard, without its text.

    Returns ``key``, ``size`` (UTF-8 bytes of the text plus one; null: none),
    ``text_crc32``, ``shard``, ``slot`` (0.. without gaps in its shard) and
    ``grown_shard``, the shard in ``next_tree`` (null without one).

    The key alone decides the shard: repeated rows and null keys go where
    their key goes, each with a slot of its own. Other columns are ignored.
    Empty in, empty out.
    """
    text = F.coalesce("text", F.lit(""))
    after = shard_of(next_tree, F.col(key)) if next_tree else F.lit(None).cast("int")
    rows = docs.select(
        key,
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(tree, F.col(key)).alias("shard"),
        after.alias("grown_shard"),
    )
    return with_slots(rows, "shard").select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def with_slots(rows: DataFrame, group: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, never a group in one task.

    Rows are numbered inside (group, task that wrote them), and each such part
    starts after the parts before it. The order is that of the input.
    """
    stored = materialise(rows.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")), "placed")
    inside = Window.partitionBy(group, "_task").orderBy("_at")
    sizes = stored.groupBy(group, "_task").agg(F.count("*").alias("_n"))  # one row per group and task
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(group, "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    numbered = stored.withColumn("_in", F.row_number().over(inside) - 1)
    joined = numbered.join(materialise(bases, "slot-bases"), [group, "_task"])
    return joined.select(*rows.columns, (F.col("_in") + F.col("_base")).alias("slot"))
