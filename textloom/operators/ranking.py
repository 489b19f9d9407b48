"""Ranking of scored candidates per group: tables ``(grp.., item, score)``.

Items are unique in their group. A group may be of any size: totals, cut-offs
and running shares go through ``plans.grouped``. Steps that follow one another
can share one ``find_hot`` result; they then also share one shuffle by group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.hashing import uniform
from textloom.plans.grouped import LARGE_K, HotGroups, find_hot, group_cutoff, group_values, running_totals

EPS = 1e-8  # fixed value: keeps a share finite


def softmax(
    df: DataFrame, grp: Sequence[str], item: str = "item", score: str = "score", temperature: float = 1.0,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add ``prob``: softmax of the score over the group; temperature 0 leaves the scores unscaled."""
    hot = hot or find_hot(df, grp)
    scaled = df.withColumn("_x", F.col(score) / F.lit(temperature) if temperature else F.col(score))
    peaked = group_values(scaled, hot, item, {"_max": (F.max, "_x")})
    powered = peaked.withColumn("_e", F.exp(F.col("_x") - F.col("_max")))
    summed = group_values(powered, hot, item, {"_sum": (F.sum, "_e")})
    return summed.select(*df.columns, (F.col("_e") / F.col("_sum")).alias("prob"))


def renormalise(
    df: DataFrame, grp: Sequence[str], item: str = "item", prob: str = "prob", eps: float = 0.0, hot: HotGroups | None = None
) -> DataFrame:
    summed = group_values(df, hot or find_hot(df, grp), item, {"_sum": (F.sum, prob)})
    return summed.withColumn(prob, F.col(prob) / (F.col("_sum") + F.lit(eps))).drop("_sum")


def top_k_ties(
    df: DataFrame, grp: Sequence[str], k: int, item: str = "item", score: str = "score"
) -> DataFrame:
    """Items whose score reaches the k-th best: ties at the line stay."""
    cut = group_cutoff(df, grp, item, F.col(score), k, "_cut")
    return cut.where(F.col(score) >= F.col("_cut")).drop("_cut")


def top_k(
    df: DataFrame, grp: Sequence[str], k: int, item: str = "item", prob: str = "prob", eps: float = 0.0,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Exactly the k best items (the larger item first on a tie), renormalised."""
    key = F.struct(F.col(prob), F.col(item))
    if k > LARGE_K:
        cut = group_cutoff(df, grp, item, key, k, "_cut")
        return renormalise(cut.where(key >= F.col("_cut")).drop("_cut"), grp, item, prob, eps, hot)
    best = Window.partitionBy(*grp).orderBy(F.desc(prob), F.desc(item))
    kept = df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")  # limited before the shuffle
    total = F.sum(prob).over(Window.partitionBy(*grp))
    return kept.withColumn("_sum", total).withColumn(prob, F.col(prob) / (F.col("_sum") + F.lit(eps))).drop("_sum")


def top_p(
    df: DataFrame, grp: Sequence[str], p: float, item: str = "item", prob: str = "prob", eps: float = 0.0,
    hot: HotGroups | None = None,
) -> DataFrame:
    """The best items up to mass ``p``, the one that crosses it included, renormalised.

    Items run by (prob descending, null last, md5 of the item, item). A hot
    group is cut into sampled ranges of that order, so that probabilities that
    lie close together, or are all equal, spread as evenly as any others.
    """
    rows = df.withColumn("_falling", F.coalesce(-F.col(prob), F.lit(math.inf)))
    rows = rows.withColumn("_h", F.md5(F.col(item).cast("string").cast("binary")))
    hot = hot or find_hot(df, grp)
    before = running_totals(rows, grp, ["_falling", "_h", item], {"_before": F.col(prob)}, hot=hot)
    return renormalise(before.where(F.col("_before") <= p).select(*df.columns), grp, item, prob, eps, hot)


def arg_max(df: DataFrame, grp: Sequence[str], item: str = "item", score: str = "score") -> DataFrame:
    """The best item per group; the smaller item on a tie."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias("_b")
    return df.groupBy(*grp).agg(best).select(*grp, F.col("_b.i").alias(item), (-F.col("_b.s")).alias(score))


def weighted_draw(df: DataFrame, grp: Sequence[str], item: str = "item", prob: str = "prob", seed: int = 42) -> DataFrame:
    """One item per group, drawn with its probability.

    Each item waits an exponential time with its probability as rate, from a
    seeded hash, and the first one wins: one aggregate, no order inside the
    group.
    """
    wait = -F.ln(uniform(*grp, item, seed=seed)) / F.col(prob)
    return df.where(F.col(prob) > 0).groupBy(*grp).agg(F.min_by(item, wait).alias(item))


def repetition_penalty(
    df: DataFrame, history: DataFrame, grp: Sequence[str], penalty: float, item: str = "item", score: str = "score",
    pos: str = "pos", newest: int | None = None, prompt: int = 0,
) -> DataFrame:
    """Divide the score of items that the group's history repeats.

    Whole history: once per occurrence after the first. With ``newest`` only
    the last ``newest`` entries count, each once if the item came before it or
    the entry lies in the prompt, the positions below ``prompt``.
    """
    grp = list(grp)
    if newest is None:
        counted = history.groupBy(*grp, item).agg((F.count("*") - 1).alias("_m"))
    else:
        cut = group_cutoff(history, grp, pos, F.col(pos), newest, "_cut")
        n_late = F.count(F.when(F.col(pos) >= F.col("_cut"), 1))
        first_is_late = F.when((n_late == F.count("*")) & (F.min(pos) >= prompt), F.least(n_late, F.lit(1))).otherwise(F.lit(0))
        counted = cut.groupBy(*grp, item).agg((n_late - first_is_late).alias("_m"))
    joined = df.join(counted, [*grp, item], "left")
    divided = F.col(score) / F.pow(F.lit(float(penalty)), F.coalesce("_m", F.lit(0)))
    return joined.withColumn(score, divided).select(*df.columns)


def length_penalty(score: Column, item: Column, stop: str | int, step: Column, below: int, mode: str = "ratio") -> Column:
    """Change the stop item's score while ``step < below``.

    ``ratio`` divides by the share of steps still missing, ``one_plus`` by one
    more than that share.
    """
    missing = (F.lit(below) - step) / F.lit(float(below))
    divisor = {"ratio": missing, "one_plus": missing + 1}[mode]
    return F.when((item == F.lit(stop)) & (step < below), score / divisor).otherwise(score)


def last_items(ids: Column, n: int) -> Column:
    """The last ``n`` elements of an array, or all of a shorter one."""
    return F.slice(ids, F.greatest(F.size(ids) - F.lit(n - 1), F.lit(1)), F.lit(n))
