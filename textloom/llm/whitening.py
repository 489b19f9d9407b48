"""Whitening of embeddings with a bidiagonal qd solver.

The covariance is never formed. Tasks reduce their centred rows to triangles by
blockwise QR, triangles are stacked and reduced again until one is left, and the
rest is work on that ``d x d`` triangle R alone, whatever the number of rows:

* Householder reflections from both sides make R bidiagonal;
* dqds, the shifted quotient-difference algorithm, finds the singular values to
  high relative accuracy, as it subtracts nothing but its shifts;
* a twisted factorisation of ``B'B - s**2`` at a singular value ``s`` gives its
  vector: the twist is put where the two factors meet with the least remainder;
* reflections carry the vectors back. Eigenvalues of the covariance are
  ``s**2 / n``.

Vectors are quantised to integers first, so counts and sums are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.shared_dir import materialise

COMPONENTS = 4
SCALE = 256
MAX_DIMENSIONS = 1024  # size check of the triangles, 8 MB each at most
FAN_IN = 16  # triangles reduced at a time
BLOCK_ROWS = 4096

_EPS = np.finfo(float).eps


def _reflection(x: np.ndarray) -> np.ndarray:
    """Unit normal of the mirror that takes ``x`` to its first axis; zero if there is nothing to do."""
    v, norm = x.astype(float), np.linalg.norm(x)
    if norm:
        v[0] += math.copysign(norm, x[0])
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of ``B = Q'RP`` for a square R, and the mirrors of ``P``."""
    a = np.array(r, float)
    d = len(a)
    right: list[np.ndarray] = []
    for k in range(d):
        v = _reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            w = _reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _carried_back(y: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """``P y``."""
    out = y.copy()
    for k in reversed(range(len(right))):
        out[k + 1 :] -= 2 * right[k] * (right[k] @ out[k + 1 :])
    return out


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None if the shift is not below the least eigenvalue."""
    new_q, new_e = [], []
    d = q[0] - shift
    for low, rest in zip(q[1:], e, strict=True):
        if d < 0 or d + rest == 0:
            return None
        new_q.append(d + rest)
        ratio = low / new_q[-1]
        new_e.append(rest * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def _least_of_last_two(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows of LU; never below the least one."""
    top, low = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    half = (top - low) / 2
    root = math.hypot(half, math.sqrt(q[-2] * e[-1]))
    return low + half - root if half < 0 else low - q[-2] * e[-1] / (half + root) if root else low


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of a bidiagonal matrix, falling.

    The shift is tried a little below an upper bound of the least eigenvalue
    and moved away from it while it is too large; 0 always works. An off-diagonal
    entry too small to count cuts the matrix in two.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    floor = _EPS**4  # stands for 0 on the diagonal
    q = [max(x, floor) for x in ((diagonal / scale) ** 2).tolist()]
    parts = [(q, ((above / scale) ** 2).tolist(), 0.0)]
    found: list[float] = []
    while parts:
        q, e, moved = parts.pop()
        distance = 1.0
        while len(q) > 1:
            small = _EPS**2 * (moved + min(q))
            cut = next((i for i in reversed(range(len(e))) if e[i] <= small), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            shift = max(0.0, _least_of_last_two(q, e) * (1 - distance))
            step = _sweep(q, e, shift)
            if step is None:
                if shift == 0:
                    q = [max(x, floor) for x in q]
                distance = min(1.0, distance * 4)
                continue
            (q, e), moved = step, moved + shift
            q = [max(x, floor * _EPS) for x in q]
            distance = max(distance / 4, 1e-9)
        found += [x + moved for x in q]
    return scale * np.sqrt(np.sort(np.array(found))[::-1])


def _twisted(d: np.ndarray, ratio: np.ndarray, value: float) -> list[np.ndarray]:
    """Vectors of ``LDL' - value`` by its twisted factorisations, the best twist first.

    ``d`` is D and ``ratio`` the subdiagonal of L. Stationary steps go down,
    progressive ones up; ``gamma`` is what is left where they meet.
    """
    n, tiny = len(d), np.finfo(float).tiny / _EPS
    down, up = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i] or tiny
        down[i] = d[i] * ratio[i] / pivot
        s[i + 1] = down[i] * ratio[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in reversed(range(n - 1)):
        pivot = d[i] * ratio[i] ** 2 + p[i + 1] or tiny
        up[i] = ratio[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    gamma = np.abs(s + p + value)

    def vector(r: int) -> np.ndarray:
        z = np.zeros(n)
        z[r] = 1
        for i in reversed(range(r)):
            z[i] = -down[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -up[i] * z[i]
        return z / np.linalg.norm(z)

    with np.errstate(all="ignore"):
        found = [vector(int(r)) for r in np.argsort(gamma, kind="stable")[:4]]
    return [z for z in found if np.isfinite(z).all()]


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of a square R, falling, and their right vectors as columns.

    Values that rounding cannot tell from 0 are left out. Vectors of values that
    are close together are made orthogonal; where they coincide, inverse
    iteration finds another one of the same space.
    """
    diagonal, above, right = bidiagonalise(r)
    values = singular_values(diagonal, above)
    if not len(values) or values[0] == 0:
        return np.zeros(0), np.zeros((len(r), 0))
    values = values[values > 8 * len(r) * _EPS * values[0]][:most]
    a = np.where(np.abs(diagonal) < _EPS**2 * values[0], _EPS**2 * values[0], diagonal)
    d, ratio = a**2, above / a[:-1]
    full = np.diag(diagonal) + np.diag(above, 1)
    full = full.T @ full
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    for s in values:
        found = None
        for z in _twisted(d, ratio, s * s):
            z = _cleared(z, vectors)
            if (length := np.linalg.norm(z)) > 0.5:
                z = z / length
                if np.linalg.norm(full @ z - s * s * z) <= 1e-12 * len(r) * values[0] ** 2:
                    found = z
                    break
        if found is None:
            z = _cleared(rng.standard_normal(len(r)), vectors)
            shifted = full - s * s * (1 + 64 * _EPS) * np.eye(len(r))
            for _ in range(4):
                z = _cleared(np.linalg.solve(shifted, z / np.linalg.norm(z)), vectors)
            found = z / np.linalg.norm(z)
        vectors.append(found)
    return values, np.stack([_carried_back(z, right) for z in vectors], axis=1)


def _cleared(z: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in vectors:
            z = z - (v @ z) * v
    return z


@dataclass
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``directions`` scaled to whiten, ``explained`` shares of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]
    identity_error: float


def quantised(vector: Column) -> Column:
    """Entries as ``floor(SCALE * entry)``; null for a vector that is null or holds null or a number that is not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return F.when(F.forall(vector, finite), whole)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` that can be whitened, with their integers in ``x``, which replaces a column of that name.

    Left out are null vectors, those with an entry that is null or not finite,
    and those of another length than most (of equally frequent lengths the
    larger one counts).
    """
    rows = vectors.withColumn("x", quantised(F.col(f"`{vector}`"))).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths.d if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in source:
        x = _matrix(rows.column("x"))
        wide = x if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62 else x.astype(object)
        sums = [Decimal(int(s)) for s in wide.sum(axis=0)]
        arrays = [pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.decimal128(38, 0)), pa.array([len(x)] * len(sums), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "s", "n"])


def _triangles(mean: np.ndarray):
    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(mean)))
        for rows in source:
            x = _matrix(rows.column("x"))
            for a in range(0, len(x), BLOCK_ROWS):
                r = np.linalg.qr(np.vstack([r, x[a : a + BLOCK_ROWS] - mean]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["part", "r"])

    return work


def _stacked(dimensions: int):
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b).reshape(-1, dimensions) for b in frame.sort_values("part")["r"]]
        return pd.DataFrame({"part": [key[0]], "r": [np.linalg.qr(np.vstack(parts), mode="r").tobytes()]})

    return work


def _triangle(fit_list: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows. The driver gets one triangle."""
    d, kind = len(mean), "part bigint, r binary"
    parts = materialise(fit_list.mapInArrow(_triangles(mean), kind), "triangles")
    while parts.count() > FAN_IN:
        dealt = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = materialise(dealt.groupBy("part").applyInPandas(_stacked(d), kind), "triangles")
    last = parts.groupBy(F.lit(0).cast("bigint").alias("_")).applyInPandas(_stacked(d), kind).first()  # FAN_IN rows
    r = np.frombuffer(last.r).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def _moments(directions: np.ndarray, mean: np.ndarray):
    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = directions.shape[1]
        total = np.zeros((k + 1, k))
        for rows in source:
            w = (_matrix(rows.column("x")) - mean) @ directions
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        arrays = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "v"])

    return work


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from each distinct ``x`` of ``rows`` (see ``usable``) once; None without rows or entries.

    There are at most ``components`` directions, and fewer where the vectors
    span less: equal vectors alone have none.
    """
    fit_list = materialise(rows.select("x").distinct(), "fit-list")
    found = fit_list.mapInArrow(_sums, "i int, s decimal(38,0), n bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums = found.orderBy("i").limit(MAX_DIMENSIONS + 1).collect()
    if len(sums) > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")
    if not sums:
        return None
    n, exact = sums[0].n, [int(r.s) for r in sums]
    mean = np.array([s / n for s in exact])
    r = _triangle(fit_list, mean)
    values, vectors = right_vectors(r, components)
    directions = vectors * (math.sqrt(n) / values) if len(values) else vectors
    k, error = len(values), 0.0
    if k:
        moments = fit_list.mapInArrow(_moments(directions, mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((k + 1, k))
        for m in moments:
            total[m.i, m.j] = m.v / n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return Whitening(n, exact, directions, (values**2 / (r**2).sum()).tolist() if k else [], error)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of ``(n * x - S)**2``, exact; null beyond 64 bits."""
    s = np.array(sums, object)
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if len(sums) * largest**2 < 1 << 63:
        return ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in ((n * x.astype(object) - s) ** 2).sum(axis=1).tolist()]


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every row and component of the model.

    ``rows`` are those of ``usable``. Components count from 1. Repeated rows
    come out as often as they went in, null keys stay null, other columns are
    ignored. Without model or direction no rows.
    """
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    if model is None or not model.explained:
        return rows.sparkSession.createDataFrame([], schema)
    mean, k = np.array([s / model.n for s in model.sums]), len(model.explained)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = _matrix(batch.column("x"))
            m = len(x)
            owner = pa.array(np.repeat(np.arange(m), k))
            arrays = [
                batch.column("key").take(owner),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(owner),
                pa.array(((x - mean) @ model.directions).ravel()),
                pa.array(np.tile(model.explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.select(F.col(f"`{key}`").alias("key"), "x").mapInArrow(work, schema)
