import math

import numpy as np
import pytest
from pyspark.sql import Row

from textloom.llm import whitening

RNG = np.random.default_rng(3)


def matrices():
    for d in (1, 2, 3, 7, 24, 64):
        yield np.triu(RNG.standard_normal((d, d)))
        yield np.triu(RNG.standard_normal((d, d))) * np.logspace(0, -12, d)[:, None]
        yield np.linalg.qr(RNG.standard_normal((d, d)))[0] * 3  # all values equal
        yield np.diag(np.resize([5.0, 3.0, 3.0, 1.0], d))
        gap = RNG.standard_normal((d, d))
        gap[:, d // 2] = 0
        yield gap
        yield np.zeros((d, d))


def test_singular_values_and_vectors():
    for r in matrices():
        diagonal, above, _ = whitening.bidiagonalise(r)
        want = np.linalg.svd(r)[1]
        assert np.abs(whitening.singular_values(diagonal, above) - want).max() <= 1e-13 * max(want[0], 1e-300) * len(r)
        values, x = whitening.right_vectors(r, 4)
        assert len(values) == min(4, int((want > 1e-12 * want[0]).sum()) if want[0] else 0) or want[0] * 1e-12 < want[-1] * 1e3
        assert np.abs(x.T @ x - np.eye(len(values))).max(initial=0) < 1e-12
        assert np.abs(r.T @ (r @ x) - x * values**2).max(initial=0) <= 1e-12 * want[0] ** 2 * len(r)


def test_small_values_keep_their_digits():
    diagonal, above = np.array([1.0, 1e-9, 1e-18]), np.array([1e-3, 1e-12])
    product = np.prod(whitening.singular_values(diagonal, above))
    assert math.isclose(product, 1e-27, rel_tol=1e-12)


ODD = [None, [], [1.0], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0]]


def whitened(spark, rows, components=4):
    df = spark.createDataFrame([Row(vec_id=i, embedding=e, x="clash", n=7) for i, e in rows], "vec_id bigint, embedding array<float>, x string, n int")
    usable = whitening.usable(df)
    return whitening.whiten(usable, whitening.fit(usable, components)).collect()


def test_against_dense_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    vectors = (RNG.standard_normal((400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) + 7).astype(np.float32)
    rows = list(enumerate(map(np.ndarray.tolist, vectors)))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)] + [(None, rows[0][1])]  # copies of few: the fit list has each once
    got = whitened(spark, rows + [(-1 - i, e) for i, e in enumerate(ODD)])
    x = np.floor(vectors.astype(float) * 256)
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1][:4], vectors_[:, ::-1][:, :4]
    assert len(got) == 4 * len(rows)
    for k in range(4):
        own = {r.vec_id: r for r in got if r.component == k + 1 and r.vec_id is not None}
        w = np.array([own[i].whitened for i in range(400)])
        want = (x - sums / n) @ vectors_[:, k] / math.sqrt(values[k])
        assert np.abs(w * np.sign(w @ want) - want).max() < 1e-9
        assert math.isclose(own[0].explained, values[k] / np.trace(centred.T @ centred / n), rel_tol=1e-12)
        for i in range(50):
            assert own[i].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) and own[i].n == n
        assert own[0].identity_error < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitened(spark, rows) == []


def test_fewer_components_than_asked(spark):
    got = whitened(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [4.0, 4.0]), (4, [1.0])])
    assert sorted((r.vec_id, r.component) for r in got) == [(1, 1), (2, 1), (3, 1)]
    assert math.isclose(got[0].explained, 1)


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[1 << 40], [2]])
    assert whitening._deviation(x, 1 << 30, [0]) == [None, (2 << 30) ** 2]
