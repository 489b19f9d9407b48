"""Run logs, schedules and artifact lists as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions.names import (
    captured_step,
    is_interrupted_artifact,
    is_step_artifact,
    split_step,
)
from textloom.plans.grouped import best_keys, group_cutoff, row_numbers, running_totals


def tokens_seen(df: DataFrame, run: Sequence[str], step: str, n: Column, name: str = "tokens_seen") -> DataFrame:
    """Running sum of ``n`` along the steps of a run, the step included."""
    out = running_totals(df.withColumn("_n", n), run, [step], {name: F.col("_n")})
    return out.withColumn(name, F.col(name) + F.col("_n")).drop("_n")


def first_batches(df: DataFrame, split: Sequence[str], batch_id: str, n: int, loss: str = "loss") -> DataFrame:
    """``(split.., loss)`` of the first ``n`` batches of each split, limited before the shuffle."""
    key = F.struct((-F.col(batch_id)).alias("b"), F.col(loss).alias("l"))
    return best_keys(df, split, key, n).select(*split, F.col("_k.l").alias(loss))


def mean_first_batches(df: DataFrame, splits: Sequence[str], num_batches: int | None, split: str = "split",
                       batch_id: str = "batch_id", loss: str = "loss") -> DataFrame:
    """Mean loss of the first batches per split; NaN for a split without any."""
    used = df if num_batches is None else df.where(F.col(batch_id) < num_batches)
    means = used.groupBy(split).agg(F.avg(loss).alias("mean_loss"))
    names = df.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
    return names.join(means, split, "left").select(split, F.coalesce("mean_loss", F.lit(float("nan"))).alias("mean_loss"))


def sampled_steps(df: DataFrame, run: Sequence[str], step: str, every: int) -> DataFrame:
    """Every ``every``-th step, and the first step of each run."""
    first = df.groupBy(*run).agg(F.min(step).alias("_first"))
    return df.join(first, list(run)).where((F.col(step) % every == 0) | (F.col(step) == F.col("_first"))).drop("_first").select(*df.columns)


def even_axis(df: DataFrame, run: Sequence[str], step: str, end: Column | float, name: str = "axis") -> DataFrame:
    """Evenly spaced values from 0 to ``end`` along the log of each run."""
    numbered = row_numbers(df, run, [step], "_rn", total="_n")
    end = end if isinstance(end, Column) else F.lit(float(end))
    at = F.when(F.col("_n") > 1, F.col("_rn") / (F.col("_n") - 1) * end).otherwise(F.lit(0.0))
    return numbered.withColumn(name, at).drop("_rn", "_n")


def long_metrics(df: DataFrame, run: str, step: str, metrics: Mapping[str, Column]) -> DataFrame:
    """``(run_id, step, metric, value)``: the shape run logs are kept in."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()])
    return df.select(F.col(run).alias("run_id"), F.col(step).alias("step"), F.inline(pairs))


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, with counters that are filled while a job reads them.

    ``rows`` is the true number of rows; further aggregates can be named.
    """
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[m.alias(k) for k, m in metrics.items()]), seen


def latest_artifact(df: DataFrame, group: Sequence[str], name: str, order: str) -> DataFrame:
    """Name with the highest step per group; the first listed one on a tie.

    Names without a number are skipped and a step must be above 0, so a group
    may have none.
    """
    steps = df.select(*group, order, name, split_step(F.col(name)).alias("step")).where(F.col("step") > 0)
    best = F.max_by(F.struct(name, "step"), F.struct(F.col("step"), -F.col(order)))
    return steps.groupBy(*group).agg(best.alias("_b")).select(*group, F.col(f"_b.{name}").alias(name), "_b.step")


def retention(df: DataFrame, group: Sequence[str], name: str, order: str, keep: int = 1) -> DataFrame:
    """Mark each artifact ``keep``, ``delete`` or ``ignore``; nothing is deleted.

    The ``keep`` highest steps of a group stay, earlier listed ones first on a
    tie. Interrupted ones always go; other names are not touched.
    """
    step = F.when(is_step_artifact(F.col(name)), captured_step(F.col(name)))
    listed = df.withColumn("step", step)
    ranked = listed.where("step IS NOT NULL")
    key = F.struct(F.col("step"), -F.col(order))
    cut = group_cutoff(ranked, group, order, key, keep, "_cut")
    kept = cut.select(*df.columns, "step", F.when(key >= F.col("_cut"), "keep").otherwise("delete").alias("action"))
    rest = listed.where("step IS NULL").withColumn(
        "action", F.when(is_interrupted_artifact(F.col(name)), "delete").otherwise("ignore")
    )
    return kept.unionByName(rest.select(kept.columns))


def epoch_position(step: Column, len_loader: Column | int) -> Column:
    """Step inside its epoch, as the log keeps it under ``epochs``; 0 in the first epoch."""
    n = len_loader if isinstance(len_loader, Column) else F.lit(len_loader)
    return F.when(step > n, step % n).otherwise(F.lit(0).cast("bigint"))


def epoch_number(step: Column, len_loader: Column | int) -> Column:
    n = len_loader if isinstance(len_loader, Column) else F.lit(len_loader)
    return F.floor(step / n).cast("bigint")
