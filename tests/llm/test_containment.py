"""Decontamination against a direct search of every window."""

import numpy as np
import pytest

from textloom.llm import containment


def words_of(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c > "\x7f" or c.isascii() and c.isalnum():
            word += c
        else:
            out, word = (out + [word] if word else out), ""
    return out + [word] if word else out


def brute(rows, items, window=10):
    places = {}
    for i, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            places.setdefault(tuple(w[s : s + window]), set()).update([] if i is None else [str(i)])
    out = []
    for d, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in {len(p) for p in places}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in places:
                    hit.update(range(s, s + n))
                    found |= places[k]
        out.append((d, len(w), len(hit), len(found), sorted(found)))
    return out


def check(spark, rows, items):
    docs = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id bigint, text string, items string, _spans int")
    bench = spark.createDataFrame([(*r, "b") for r in items], "item_id bigint, text string, window string")
    out = containment.contained(docs.repartition(3), bench)
    assert out.columns == ["doc_id", "text", "items", "_spans", "containment"]
    found = [(r.doc_id, *r.containment) for r in out.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(brute(rows, items), key=key)
    clean = containment.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(r[2] == 0 for r in brute(rows, items))


ITEMS = [
    (1, " ".join(f"b{i}" for i in range(25))), (2, "One, TWO three!"), (3, None), (4, " ,. "), (5, "x"),
    (6, " ".join(f"b{i}" for i in range(5, 15))), (6, "same id again with ten words or more in this text"), (None, "no name here"), (7, "ab ab ab ab ab ab ab ab ab ab ab"),
]


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_planted_windows(spark, monkeypatch, at_once):
    monkeypatch.setattr(containment, "WINDOWS_AT_ONCE", at_once)
    b = [f"b{i}" for i in range(25)]
    rows = [
        (1, None), (2, ""), (3, "one two THREE"), (4, "one two"), (None, "X"), (5, " ".join(b)), (5, " ".join(b)), (6, " ".join(b[3:12])),
        (7, "; ".join(b[3:14]) + " other " + " ".join(b[10:])), (8, "no name-here"), (9, "ab " * 30), (10, "é" + "x"), (11, "  \n,,"),
        (12, "pad " * 30_000 + " ".join(b) + " pad"), (13, " ".join(b[:10]) + "one two three"),
    ]
    check(spark, rows, ITEMS)


def test_random_texts(spark):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3, int(rng.integers(1, 14))))) for i in range(6)]
    rows = [(d, " ".join(f"v{x}" for x in rng.integers(0, 3, int(rng.integers(0, 300))))) for d in range(40)]
    check(spark, rows, items)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert [tuple(r.containment) for r in containment.contained(docs, bench.limit(0)).orderBy("doc_id").collect()] == [(3, 0, 0, []), (0, 0, 0, [])]
    assert containment.contained(docs.limit(0), bench).count() == 0
