"""Connected components of a graph that only ever lives in tables.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
links the neighbours of a node to the least of them, which shortens long paths
and ends in one star per component. A node with very many neighbours costs one
row of a minimum, combined before the shuffle, and a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.shared_dir import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(u, v)`` that are not the least of their component.

    ``root`` is the least node reachable. Values are integers, not null; loops
    and repeated edges do no harm. No edges: no rows.
    """
    now = materialise(edges.where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
