"""Repeated passages against a direct comparison of all windows."""

import numpy as np
import pytest

from textloom.llm import anchors


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def brute(rows, window=13):
    least = {}
    ids = [anchors.LAST_ID if r[0] is None else r[0] for r in rows]
    for d, (_, text) in zip(ids, rows, strict=True):
        w = words_of(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, (own, text) in zip(ids, rows, strict=True):
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((own, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, rows, partitions=4):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, _id string, kept int")
    found = [tuple(r) for r in anchors.without_repeats(docs.repartition(partitions)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(brute(rows), key=key)


def passages(seed, n=120, vocabulary=4000):
    rng = np.random.default_rng(seed)
    shared = [[f"s{x}" for x in rng.integers(0, vocabulary, int(rng.integers(10, 40)))] for _ in range(12)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(int(rng.integers(1, 5))):
            words += [f"w{x}" for x in rng.integers(0, vocabulary, int(rng.integers(0, 60)))]
            if rng.random() < 0.6:
                words += shared[int(rng.integers(len(shared)))]
        rows.append((int(rng.integers(0, n)) if rng.random() < 0.2 else d, " ".join(words)))
    return rows


@pytest.mark.parametrize("batch_words", [3_000_000, 300])
def test_shared_passages(spark, monkeypatch, batch_words):
    monkeypatch.setattr(anchors, "BATCH_WORDS", batch_words)
    check(spark, passages(batch_words))


def test_many_ranges_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(anchors, "GROUP_BYTES", 1 << 10)
    check(spark, passages(7))


def test_small_vocabulary(spark):
    check(spark, passages(3, n=60, vocabulary=2))


def test_odd_rows(spark):
    a = " ".join(f"a{i}" for i in range(20))
    long = " ".join(f"l{i}" for i in range(40_000))
    check(spark, [
        (1, None), (2, ""), (3, " \t\n"), (4, a), (4, a), (4, a + " more"), (None, a), (None, a), (None, None), (7, "x " + a.replace(" ", "\n")),
        (8, " ".join(a.split()[:12])), (9, " ".join(a.split()[:13])), (10, long), (11, long), (-3, "é " * 30), (12, "é " * 14 + "ü"),
    ])


def test_packed_arrays_round_trip():
    for values in ([], [0], [1 << 63, 5, 0], list(range(300))):
        a, b = anchors._unpack(anchors._pack(np.array(values, np.uint64), np.array([7], np.uint64)))
        assert a.tolist() == values and b.tolist() == [7]


def test_empty(spark):
    assert anchors.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
