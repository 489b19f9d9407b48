"""Near duplicates by five-word shingles against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import near_sets
from textloom.llm.simhash import forest


def jaccard(a, b):
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    a, b = cut(a.lower().split()), cut(b.lower().split())
    return len(a & b) / len(a | b)


def test_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(80, 400))]
        texts.append(" ".join(words))
        for most in (1, 2, 4, 6, 9):  # copies with some words replaced, on both sides of the bound
            own = list(words)
            for _ in range(most):
                own[rng.randrange(len(own))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(own))
    texts += ["One two", "one  two", "one two three", None, " ", ""]
    best = list(range(len(texts)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    near = 0
    for i, t in enumerate(texts):
        for j in range(i):
            if jaccard(t or "", texts[j] or "") >= 0.8:
                a, b = sorted((root(i), root(j)))
                best[b], near = a, near + 1
    assert near > 200
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id for r in out.collect()}
    assert got == {root(i) for i in range(len(texts))}
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize(("rounds", "block"), [(1, 8), (3, 256)])
def test_no_link_of_a_crowd_is_lost(spark, rounds, block):
    """Variants of one text share bands without all being similar: every similar pair hangs together."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        own = list(words)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(own))
    sets = [near_sets.shingle_set(t) for t in texts]
    meet = [set(enumerate(near_sets.bands(s))) for s in sets]
    near = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if meet[i] & meet[j] and (both := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    edges = near_sets.similar_pairs(df, pairs=0, rounds=rounds, block=block)
    label = forest(len(texts), *np.array([tuple(e) for e in edges.collect()]).T)
    want = forest(len(texts), *np.array(near).T)
    assert label.tolist() == want.tolist() and 1 < len(set(want)) < 200
    assert {tuple(sorted(e)) for e in edges.collect()} <= {(j, i) for i, j in near}


def test_far_variants_of_a_crowd_make_no_table_of_pairs(spark, monkeypatch):
    """Texts that share bands without being similar: no table grows with the square of the crowd."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        own = list(words)
        for _ in range(rng.randrange(4, 9) if i else 0):
            own[rng.randrange(len(own))] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(own))
    sets = [near_sets.shingle_set(t) for t in texts]
    meet = [set(enumerate(near_sets.bands(s))) for s in sets]
    assert sum(bool(meet[i] & meet[j]) for i in range(400) for j in range(i)) > 30_000
    rows = {}

    def counted(df, name, write=near_sets.materialise):
        out = write(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_sets, "materialise", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    near_sets.similar_pairs(df, pairs=0).collect()
    assert max(rows.values()) <= 400 * near_sets.BANDS, rows
