"""Limits per group: the best keys and the line they draw."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import runs
from textloom.plans import grouped


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(5)
    rows = [(g, i, rnd.randrange(30)) for g, n in (("a", 200), ("b", 3), ("c", 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, i bigint, s bigint")


@pytest.mark.parametrize(("k", "large"), [(1, 1 << 16), (7, 1 << 16), (7, 3), (500, 3)])
def test_cutoff_is_the_kth_best(scored, monkeypatch, k, large):
    monkeypatch.setattr(grouped, "LARGE_K", large)
    rows, df = scored
    want = {}
    for g in "abc":
        own = sorted((s for h, _, s in rows if h == g), reverse=True)
        want[g] = own[min(k, len(own)) - 1]
    got = grouped.group_cutoff(df, ["g"], "i", F.col("s"), k).collect()
    assert len(got) == len(rows)
    assert all(r.cutoff == want[r.g] for r in got)


def test_groups_are_limited_before_the_shuffle(scored):
    _, df = scored
    plan = grouped.group_cutoff(df, ["g"], "i", F.col("s"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_batches_and_steps(scored):
    rows, df = scored
    got = runs.first_batches(df, ["g"], "i", 20, "s").collect()
    assert sorted(tuple(r) for r in got) == sorted((g, s) for g, i, s in rows if i < 20)
    kept = runs.sampled_steps(df.where("i > 0"), ["g"], "i", 50).collect()
    assert sorted((r.g, r.i) for r in kept) == [("a", 1), ("a", 50), ("a", 100), ("a", 150), ("b", 1)]
    plan = runs.sampled_steps(df, ["g"], "i", 50)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
