"""Windows inside a row are cut where the row is; the rest meet in a shuffle."""

import random

import pytest

from textloom.operators import pack


@pytest.mark.parametrize(("length", "stride"), [(5, 3), (4, 9), (3, 1), (1, 1)])
def test_inner_and_crossing_windows(spark, length, stride):
    rng = random.Random(length)
    rows = [(s, i, [rng.randrange(99) for _ in range(rng.choice((0, 1, 2, 7, 40)))]) for s in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "s string, i bigint, ids array<int>")
    got = sorted(map(tuple, pack.pack(df, ["s"], "i", max_length=length, stride=stride).collect()))
    want, step = [], min(stride, length + 1)
    for s in "ab":
        ids = [x for t, _, own in rows if t == s for x in own]
        for k in range(max(0, (len(ids) - length - 1) // step + 1)):
            want.append((s, k, len(ids), ids[k * step :][:length], ids[k * step + 1 :][:length]))
    assert got == want


def test_inner_windows_are_not_grouped(spark):
    df = spark.createDataFrame([("a", 0, list(range(100))), ("a", 1, list(range(50)))], "s string, i bigint, ids array<int>")
    plan = pack.pack(df, ["s"], "i", max_length=5, stride=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and plan.count("collect_list") == 1
