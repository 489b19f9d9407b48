"""Positions and windows along keys of any type: sampled ranges against plain Python."""

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.operators import pack, split
from textloom.plans import grouped


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(grouped, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(grouped, "BUCKETS_PER_RANGE", 4)


def _key(kind, i):
    digest = hashlib.md5(str(i).encode()).hexdigest()
    return {
        "hashed": int(digest[:16], 16) - (1 << 63),
        "text": digest[: 1 + i % 9] + f"-{i}",
        "decimal": Decimal(i * i) / 7 if i % 2 else -Decimal(i) / 3,
    }[kind]


TYPES = {"hashed": "bigint", "text": "string", "decimal": "decimal(30,6)"}


def _table(spark, kind):
    rnd = random.Random(3)
    # "h" holds well over a third of the rows, and many groups share a range
    rows = [(rnd.choice(["h", "h", "h", f"s{i % 40}"]), _key(kind, i), rnd.randint(0, 9)) for i in range(2000)]
    return rows, spark.createDataFrame(rows, f"g string, k {TYPES[kind]}, v bigint").repartition(6)


@pytest.mark.parametrize("kind", list(TYPES))
def test_totals_along_any_key(spark, small_ranges, kind):
    _, df = _table(spark, kind)
    rows = [tuple(r) for r in df.collect()]
    out = grouped.totals_by_range(df, ["g"], ["k"], {"before": F.col("v")}, {"whole": "before"}).collect()
    want, seen = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        want[g, k] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
    assert {(r.g, r.k): (r.before, r.whole) for r in out} == {x: (b, seen[x[0]]) for x, b in want.items()}
    assert len(out) == len(rows)


def test_no_range_is_large(spark, small_ranges):
    # nine of ten keys lie close together: shifting them would put all in one bucket
    rows = [(i if i % 10 else i << 40,) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "k bigint").repartition(5)
    dealt = grouped.in_ranges(df, ["k"])
    sizes = [r.n for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 100 and len(sizes) >= 30
    limits = dealt.groupBy("_range").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("_range").collect()
    assert all(x.b < y.a for x, y in zip(limits, limits[1:]))
    numbered = split.number_rows(df, ["k"], any_key=True).collect()
    assert {r.k: r.rn for r in numbered} == {k: i for i, (k,) in enumerate(sorted(rows))}
    assert {r.n_rows for r in numbered} == {3000}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, k string, ids array<int>")
    assert grouped.positions(df, ["g"], ["k"]).columns == ["g", "k", "ids", "rn"]
    assert grouped.positions(df, ["g"], ["k"]).count() == 0
    assert pack.pack(df, ["g"], "k", any_key=True, numbered=True).count() == 0
    assert pack.count_windows(pack.with_sizes(df), ["g"], "n_ids").first().n_rows == 0


def test_repeated_and_null_keys_fail(spark, small_ranges):
    def run(rows, **options):
        df = spark.createDataFrame(rows, "s string, o bigint, ids array<int>")
        return pack.pack(df, ["s"], "o", max_length=2, stride=1, **options).collect()

    good = [("a", 1, [1, 2]), ("a", 2, [3]), ("b", 1, [4, 5, 6])]
    assert len(run(good)) == len(run(good, any_key=True)) == 2
    for any_key in (False, True):
        with pytest.raises(Exception, match="o must not be null"):
            run([*good, ("a", None, [7])], any_key=any_key)
        with pytest.raises(Exception, match="s must not be null"):
            run([*good, (None, 3, [7])], any_key=any_key)
    with pytest.raises(Exception, match="a key repeats"):
        run([*good, ("a", 2, [7])], any_key=True)
    crowd = spark.createDataFrame([(1,)] * 500, "k int")
    with pytest.raises(ValueError, match="repeat too often"):
        grouped.positions(crowd, [], ["k"])


def test_windows_along_a_digest(spark, small_ranges):
    rnd = random.Random(8)
    rows = [
        ("big" if i % 3 else f"s{i % 4}", hashlib.md5(str(i).encode()).hexdigest(), [rnd.randint(0, 99) for _ in range(rnd.choice([0, 1, 3, 30]))])
        for i in range(700)
    ]
    df = spark.createDataFrame(rows, "s string, o string, ids array<int>").repartition(5)
    want = []
    for s in sorted({r[0] for r in rows}):
        stream = [x for r in sorted(r for r in rows if r[0] == s) for x in r[2]]
        want += [(s, i // 4, stream[i : i + 6], stream[i + 1 : i + 7]) for i in range(0, len(stream) - 6, 4)]
    for sizes in ({}, {"n_ids": "n_ids"}):
        table = pack.with_sizes(df) if sizes else df
        got = pack.pack(table, ["s"], "o", max_length=6, stride=4, any_key=True, numbered=True, **sizes).orderBy("rn").collect()
        assert [(r.s, r.win, r.input_ids, r.target_ids) for r in got] == want
        assert [(r.rn, r.n_rows) for r in got] == [(i, len(want)) for i in range(len(want))]
    assert pack.count_windows(pack.with_sizes(df), ["s"], "n_ids", 6, 4).first().n_rows == len(want)


def test_windows_meet_no_table_once_built(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('s', id % 3) AS s", "id AS o", "array(1, 2, 3) AS ids", "3L AS n_ids")
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    windows = pack.pack(stored, ["s"], "o", max_length=4, stride=3, n_ids="n_ids", numbered=True)
    text = windows._jdf.queryExecution().optimizedPlan().toString()
    # the aggregate that builds windows is the top of the plan: no join stands above it
    assert text.index("collect_list") < text.index("Join")
    counted = pack.count_windows(stored, ["s"], "n_ids", 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s:string,n_ids:bigint>" in counted
