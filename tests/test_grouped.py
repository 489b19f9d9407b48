"""Usual and hot groups must give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import ranking, runs
from textloom.plans import grouped


@pytest.fixture(params=["usual", "hot"])
def sizes(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(grouped, "HOT_ROWS", 20)
        monkeypatch.setattr(grouped, "KEYS_PER_BUCKET", 16)
        monkeypatch.setattr(grouped, "ROWS_PER_RANGE", 16)
        monkeypatch.setattr(grouped, "BUCKETS_PER_RANGE", 4)
        monkeypatch.setattr(grouped, "ROWS_PER_SALT", 8)
    return request.param


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(1)
    # group "h" holds over a third of the rows
    rows = [(rnd.choice(["h", "h", "a", "b", "c"]), i, rnd.randint(0, 9)) for i in range(600)] + [("one", 1000, 5)]
    return rows, spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(5).cache()


def test_find_hot(spark, log, sizes):
    _, df = log
    found = grouped.find_hot(df, ["g"])
    if sizes == "usual":
        assert found.table is None
    else:
        assert {r.g for r in found.table.collect()} == {"h", "a", "b", "c"}


def test_running_totals(log, sizes):
    rows, df = log
    out = grouped.running_totals(df, ["g"], ["k"], {"before": F.col("v")}, totals={"whole": "before"}).collect()
    got = {(r.g, r.k): (r.before, r.whole) for r in out}
    want, seen = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[g, k] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
    assert got == {key: (b, seen[key[0]]) for key, b in want.items()}


def test_global_row_numbers(log, sizes):
    rows, df = log
    out = {r.k: (r.rn, r.n) for r in grouped.row_numbers(df, [], ["k"], total="n").collect()}
    assert out == {k: (i, len(rows)) for i, k in enumerate(sorted(r[1] for r in rows))}


def test_top_k_and_ties(log, sizes):
    rows, df = log
    df = df.withColumn("score", F.col("v").cast("double"))
    by_group = {}
    for g, k, v in rows:
        by_group.setdefault(g, []).append((float(v), k))
    ties = {(r.g, r.k) for r in ranking.top_k_ties(df, ["g"], 3, item="k").collect()}
    want = {(g, k) for g, xs in by_group.items() for s, k in xs if s >= sorted((x for x, _ in xs), reverse=True)[:3][-1]}
    assert ties == want
    exact = ranking.top_k(df, ["g"], 3, item="k", prob="score").collect()
    best = {g: sorted(xs, reverse=True)[:3] for g, xs in by_group.items()}
    assert {(r.g, r.k) for r in exact} == {(g, k) for g, xs in best.items() for _, k in xs}
    for r in exact:
        assert r.score == pytest.approx(dict((k, s) for s, k in best[r.g])[r.k] / sum(s for s, _ in best[r.g]))


def test_softmax_and_top_p(log, sizes):
    import hashlib
    import math

    rows, df = log
    probs = ranking.softmax(df.withColumn("score", F.col("v").cast("double")), ["g"], item="k", temperature=2.0)
    got = {(r.g, r.k): r.prob for r in probs.collect()}
    total = {}
    for g, _, v in rows:
        total[g] = total.get(g, 0) + math.exp(v / 2)
    want = {(g, k): math.exp(v / 2) / total[g] for g, k, v in rows}
    assert got == pytest.approx(want)
    kept = {(r.g, r.k): r.prob for r in ranking.top_p(probs.select("g", "k", "prob"), ["g"], 0.7, item="k").collect()}
    for g in total:
        ordered = sorted(((k, p) for (h, k), p in got.items() if h == g), key=lambda x: (-x[1], hashlib.md5(str(x[0]).encode()).hexdigest()))
        mass, chosen = 0.0, {}
        for k, p in ordered:
            if mass <= 0.7:
                chosen[k] = p
            mass += p
        have = {k for (h, k) in kept if h == g}
        assert have == set(chosen)
        assert sum(p for (h, _), p in kept.items() if h == g) == pytest.approx(1.0)


def test_top_p_of_equal_items(spark, sizes):
    df = spark.createDataFrame([("h", i, 1 / 200) for i in range(200)], "g string, item bigint, prob double")
    assert 99 <= ranking.top_p(df, ["g"], 0.5).count() <= 102


def test_top_p_of_close_items_spreads(spark, monkeypatch):
    for name, size in (("HOT_ROWS", 1000), ("ROWS_PER_RANGE", 256), ("BUCKETS_PER_RANGE", 4), ("ROWS_PER_SALT", 256)):
        monkeypatch.setattr(grouped, name, size)
    dealt = []
    ranges = grouped.in_ranges
    monkeypatch.setattr(grouped, "in_ranges", lambda *a, **k: dealt.append(ranges(*a, **k)) or dealt[-1])
    total = sum(1 + i / 200_000 for i in range(4000))  # 2 percent apart
    rows = [("h", i, (1 + i / 200_000) / total) for i in range(4000)] + [("u", i, 0.25) for i in range(4)] + [("h", 4000, None)]
    df = spark.createDataFrame(rows, "g string, item bigint, prob double")
    kept = ranking.top_p(df, ["g"], 0.5).collect()
    best = [r.item for r in kept if r.g == "h"]
    assert min(best) == 4000 - len(best) and max(best) == 3999 and 1980 <= len(best) <= 2000
    assert sum(r.prob for r in kept if r.g == "h") == pytest.approx(1.0)
    assert sum(r.g == "u" for r in kept) == 3
    sizes = [r["count"] for r in dealt[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 512


def test_run_log(log, sizes):
    rows, df = log
    seen = {(r.g, r.k): r.tokens_seen for r in runs.tokens_seen(df, ["g"], "k", F.col("v")).collect()}
    acc, want = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        acc[g] = acc.get(g, 0) + v
        want[g, k] = acc[g]
    assert seen == want
    first = {g: min(k for h, k, _ in rows if h == g) for g in acc}
    sampled = {(r.g, r.k) for r in runs.sampled_steps(df, ["g"], "k", 50).collect()}
    assert sampled == {(g, k) for g, k, _ in rows if k % 50 == 0 or k == first[g]}
    axis = {(r.g, r.k): r.axis for r in runs.even_axis(df, ["g"], "k", 1.0).collect()}
    assert axis["one", 1000] == 0.0 and axis["h", max(k for g, k, _ in rows if g == "h")] == pytest.approx(1.0)


def test_retention(spark, sizes):
    rows = [("r", i, f"model_pg_{i * 10 % 170}_steps.pth") for i in range(40)]
    rows += [("r", 100, "model_pg_9_interrupted.pth"), ("r", 101, "model_pg_epoch_1.pth"), ("s", 102, "model_pg_1_steps.pth")]
    df = spark.createDataFrame(rows, "g string, o bigint, name string")
    actions = {(r.g, r.o): r.action for r in runs.retention(df, ["g"], "name", "o", keep=3).collect()}
    order = sorted(((i * 10 % 170, -i) for i in range(40)), reverse=True)[:3]
    assert {o for (g, o), a in actions.items() if a == "keep" and g == "r"} == {-o for _, o in order}
    assert actions["r", 100] == "delete" and actions["r", 101] == "ignore" and actions["s", 102] == "keep"


def test_newest_repetitions(spark, sizes):
    rnd = random.Random(5)
    hist = [(g, i, rnd.choice("xyz")) for i in range(120) for g in "ab"]
    scores = [(g, x, 8.0) for g in "ab" for x in "xyzw"]
    out = ranking.repetition_penalty(
        spark.createDataFrame(scores, "g string, item string, score double"),
        spark.createDataFrame(hist, "g string, pos bigint, item string"), ["g"], 2.0, newest=2,
    ).collect()
    want = {}
    for g, x, s in scores:
        mine = [i for h, i, y in hist if h == g and y == x]
        late = [i for i in mine if i >= 118]
        want[g, x] = s / 2 ** (len(late) - (1 if late and len(late) == len(mine) else 0))
    assert {(r.g, r.item): r.score for r in out} == want


def test_entries_of_the_prompt_count_as_seen(spark, sizes):
    hist = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z")], "g string, pos bigint, item string")
    scores = spark.createDataFrame([("a", x, 8.0) for x in "xyz"], "g string, item string, score double")
    out = ranking.repetition_penalty(scores, hist, ["g"], 2.0, newest=2, prompt=2)
    assert {r.item: r.score for r in out.collect()} == {"x": 8.0, "y": 4.0, "z": 8.0}


def test_more_hot_groups_than_are_sent(spark, monkeypatch):
    for name, value in {"HOT_ROWS": 20, "HOT_PARTS": 1, "ROWS_PER_SALT": 8}.items():
        monkeypatch.setattr(grouped, name, value)
    df = spark.createDataFrame([(i % 3, i, i % 7) for i in range(90)] + [(9, 500, 1)], "g int, k bigint, v int")
    hot = grouped.find_hot(df, ["g"])
    assert not hot.few and hot.table.count() == 3
    out = grouped.group_values(df, hot, "k", {"s": (F.sum, "v")}).select("g", "s").distinct().collect()
    assert {r.g: r.s for r in out} == {g: sum(i % 7 for i in range(90) if i % 3 == g) for g in range(3)} | {9: 1}
    numbered = grouped.row_numbers(df, ["g"], ["k"], hot=hot).collect()
    assert {(r.g, r.k): r.rn for r in numbered} == {(i % 3, i): i // 3 for i in range(90)} | {(9, 500): 0}


def test_usual_groups_share_one_shuffle(spark, log):
    _, df = log
    df = df.withColumn("score", F.col("v").cast("double"))
    hot = grouped.find_hot(df, ["g"])
    probs = ranking.softmax(df, ["g"], item="k", hot=hot)
    out = ranking.top_k(probs, ["g"], 3, item="k", hot=hot)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
