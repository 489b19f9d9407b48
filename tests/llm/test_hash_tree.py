"""Weighted hash tree: shares, movement, slots."""

import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import hash_tree as ht


def shards(spark, n, *trees):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    return df.select("doc_id", *[ht.shard_of(t, F.col("doc_id")).alias(f"s{i}") for i, t in enumerate(trees)]).collect()


def test_shares_follow_weights(spark):
    tree = {"a": {"r1": {0: 1.0, 1: 3.0}, "r2": {2: 2.0}}, "b": {"r3": {3: 2.0, 4: 0.0}}}
    found = [r.s0 for r in shards(spark, 40_000, tree)]
    for shard, share in {0: 1 / 8, 1: 3 / 8, 2: 1 / 4, 3: 1 / 4, 4: 0}.items():
        assert abs(found.count(shard) / 40_000 - share) < 0.01


def test_a_grown_tree_moves_rows_only_into_the_new_shard(spark):
    for n in (1, 2, 5, 8):
        tree = ht.even_tree(n)
        rows = shards(spark, 20_000, tree, ht.grown(tree, n))
        assert all(r.s1 in (r.s0, n) for r in rows)
        assert abs(sum(r.s1 == n for r in rows) / 20_000 - 1 / (n + 1)) < 0.02


def test_movement_stays_in_the_changed_subtree(spark):
    tree = {"a": {"r1": {0: 1.0, 1: 1.0}, "r2": {2: 1.0, 3: 1.0}}, "b": {"r3": {4: 1.0, 5: 1.0}, "r4": {6: 1.0, 7: 1.0}}}
    same = {"a": {"r1": {0: 1.5, 1: 0.5}, "r2": tree["a"]["r2"]}, "b": tree["b"]}  # the rack's sum is as before
    assert all(r.s0 == r.s1 or {r.s0, r.s1} == {0, 1} for r in shards(spark, 20_000, tree, same))
    lighter = {"a": tree["a"], "b": {"r3": {4: 1.0, 5: 0.25}, "r4": tree["b"]["r4"]}}
    assert all(r.s0 == r.s1 or r.s0 >= 4 for r in shards(spark, 20_000, tree, lighter))


def test_place_odd_rows(spark):
    rows = [(1, "ab"), (1, "ab"), (1, "é"), (None, None), (None, "x"), (2, ""), (3, "y" * 100_000), (-5, "ab")]
    rows += [(i, "t") for i in range(100, 400)]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id bigint, text string, shard int, size string")
    tree = ht.even_tree(8)
    out = ht.place(docs.repartition(5), tree, next_tree=ht.grown(tree, 8)).collect()
    want = sorted(((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == want
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    for d in {r[0] for r in rows}:
        assert len({r.shard for r in out if r.doc_id == d}) == 1
    assert ht.place(docs.limit(0), tree).count() == 0


def test_a_tree_without_weight_is_refused():
    with pytest.raises(ValueError):
        ht.shard_of({"a": {"r": {0: 0.0}}}, F.lit(1))
