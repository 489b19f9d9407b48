"""SimHash near duplicates: meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * half`` bits have a value between
them that is at most ``half`` bits from either. So each fingerprint stands for
all values ("variants") within ``half`` bits, and fingerprints that meet in a
variant are linked; none is missed. Meeting ones differ in at most ``2 * half``
bits by the triangle inequality, so those of one variant are all linked with
each other, and a star to the least of them keeps every link's component
without emitting the pairs.

Variants are dealt out by their leading bits. A fingerprint goes once to each
prefix that one of its variants has (37 of 256 for eight bits and half radius
two, instead of 2081 variants), and the variants are spelled out there. A prefix
with too many for the memory is cut along further bits, so that crowded regions
cost time, not memory. A prefix that many fingerprints share, as variations of
one template do, is dealt out again along further bits before it is grouped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import component_roots
from textloom.plans.shared_dir import materialise

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
VARIANTS_AT_ONCE = 1 << 21
CROWD = 1 << 18  # fingerprints of one prefix that a task takes
CROWD_BITS = 6  # further bits along which a crowd is dealt out at once
MOST_BITS = 56  # no prefix of that length is a crowd: it has no more than 256 values in each of its variants
SENT_CROWDS = 100_000  # crowded prefixes that may go to every task


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Word shingles of the lower-cased text (A-Z), repeats included; all words if fewer than ``size``."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - size + 1)
    return [joined[a:b] for a, b in zip(starts[:n], ends[min(size, len(words)) - 1 :], strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 without words. Signed, as Spark stores it."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, size)], "<u8")
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``text`` replaced by ``fingerprint``, computed in the scan's own tasks."""
    kept = [c for c in docs.columns if c not in ("text", "fingerprint")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = pa.array((fingerprint(t.as_py(), size) for t in texts), pa.int64())
            columns = [batch.column(c) for c in kept] + [values]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "fingerprint"])

    schema = docs.select(*kept, F.lit(0).cast("bigint").alias("fingerprint")).schema
    return docs.select(*kept, "text").mapInArrow(work, schema)


def _masks(bits: int, most: int) -> list[int]:
    """All values of ``bits`` bits with at most ``most`` ones."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def _spelled(values: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants of each value in its ``bits`` low bits with at most ``left`` flips, and whose they are."""
    low = np.uint64((1 << bits) - 1)
    out, owner = [], []
    for k in np.unique(left):
        own = np.flatnonzero(left == k)
        masks = np.array(_masks(bits, int(k)), np.uint64)
        out.append(((values[own] & low)[:, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(own, len(masks)))
    return np.concatenate(out), np.concatenate(owner)


def _stars(values: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices (least fingerprint of a shared variant, another one there).

    Fingerprints agree above ``bits`` low bits up to what ``left`` has paid for.
    """
    if len(values) < 2:
        return
    ball = np.array([sum(comb(bits, j) for j in range(k + 1)) for k in range(int(left.max()) + 1)])
    if bits > 8 and int(ball[left].sum()) > VARIANTS_AT_ONCE:
        bit = (values >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (bit != side)
            own = np.flatnonzero(rest >= 0)
            for a, b in _stars(values[own], rest[own], bits - 1):
                yield own[a], own[b]
        return
    variants, owner = _spelled(values, left, bits)
    order = np.lexsort((values[owner], variants))  # the least fingerprint comes first in its variant
    variants, owner = variants[order], owner[order]
    new = np.concatenate(([True], variants[1:] != variants[:-1]))
    head = owner[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    met = np.unique(np.stack([head[~new], owner[~new]]), axis=1) if not new.all() else np.zeros((2, 0), np.int64)
    yield met[0], met[1]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the least node of each one's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def _meet(radius: int, bits: int):
    half, rest = radius // 2, BITS - bits

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(frame["fingerprint"].to_numpy(np.int64).view(np.uint64))
        paid = np.bitwise_count((values >> np.uint64(rest)) ^ np.uint64(key[0])) if bits else np.zeros(len(values))
        left = half - paid.astype(np.int64)
        label = np.arange(len(values))
        for a, b in _stars(values, left, rest):
            far = np.bitwise_count(values[a] ^ values[b]) > radius  # verified; never true
            label = forest(len(values), np.concatenate([a[~far], label]), np.concatenate([b[~far], np.arange(len(values))]))
        moved = np.flatnonzero(label != np.arange(len(values)))
        return pd.DataFrame({"u": values[moved].view(np.int64), "v": values[label[moved]].view(np.int64)})

    return work


def linked_fingerprints(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` over distinct ``fingerprint`` values whose components are those of all
    pairs with at most ``radius`` (even) differing bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half, n = radius // 2, max(1, values.count())
    ball = sum(comb(BITS, j) for j in range(half + 1))
    bits = min(30, max(0, (n * ball // VARIANTS_AT_ONCE).bit_length()))
    dealt = _dealt(values.select("fingerprint", F.lit(0).cast("bigint").alias("_p"), F.lit(half).alias("_left")), 0, bits, half)
    out = None
    while True:
        crowds, n_crowds = None, 0
        if n > CROWD and bits < MOST_BITS:  # a prefix has each fingerprint once at most
            crowds = materialise(dealt.groupBy("_p").count().where(F.col("count") > CROWD).select("_p"), "crowds")
            n_crowds = crowds.count()
        usual = dealt
        if n_crowds:
            crowds = F.broadcast(crowds) if n_crowds <= SENT_CROWDS else crowds
            usual = dealt.join(crowds, "_p", "left_anti")
        edges = usual.select("fingerprint", "_p").groupBy("_p").applyInPandas(_meet(radius, bits), "u bigint, v bigint")
        out = edges if out is None else out.unionByName(edges)
        if not n_crowds:
            return out
        more = min(CROWD_BITS, MOST_BITS - bits)
        dealt = _dealt(materialise(dealt.join(crowds, "_p", "left_semi"), "crowded"), bits, more, half)
        bits += more


def _dealt(rows: DataFrame, bits: int, more: int, half: int) -> DataFrame:
    """``(fingerprint, _p, _left)``: each row once per prefix, longer by ``more`` bits, that a variant of it has.

    ``rows`` has prefixes of ``bits`` bits; ``_left`` is how many bits a variant
    may still flip.
    """
    if not more:
        return rows
    masks = [F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(m.bit_count()).alias("k")) for m in _masks(more, half)]
    own = F.shiftrightunsigned("fingerprint", BITS - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    each = rows.select("fingerprint", "_p", "_left", F.explode(F.array(*masks)).alias("_f")).where("_f.k <= _left")
    longer = F.shiftleft("_p", more).bitwiseOR(own.bitwiseXOR(F.col("_f.m")))
    return each.select("fingerprint", longer.alias("_p"), (F.col("_left") - F.col("_f.k")).alias("_left"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    ``fingerprint`` is a signed 64-bit value; ``component_id`` the least doc_id
    reachable over links of at most ``radius`` differing bits. Null and empty
    texts have fingerprint 0, linked like any other. Repeated rows come out as
    often as they went in. A null doc_id is no name for a component: it counts
    only as a member, and a component without any other has component_id null.
    Other columns are ignored. Empty in, empty out.
    """
    return _grouped(docs.select("doc_id", "text"), radius, size).select("doc_id", "fingerprint", "component_id")


def _grouped(rows: DataFrame, radius: int, size: int) -> DataFrame:
    """``rows`` without ``text``, with ``fingerprint``, ``component_id`` and the least fingerprint of the component, ``root``."""
    prints = materialise(with_fingerprints(rows, size), "fingerprints")
    groups = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_doc")), "distinct-fingerprints")
    roots = component_roots(linked_fingerprints(groups.select("fingerprint"), radius))
    member = groups.join(roots, F.col("fingerprint") == F.col("node"), "left")
    member = member.select("fingerprint", "least_doc", F.coalesce("root", "fingerprint").alias("root"))
    member = materialise(member, "members")
    named = materialise(member.groupBy("root").agg(F.min("least_doc").alias("component_id")), "components")
    by_print = materialise(member.join(named, "root").select("fingerprint", "root", "component_id"), "component-of-fingerprint")
    return prints.join(by_print, "fingerprint")


def one_of_each(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row of every group of near duplicates, with the columns of ``docs``.

    The row with the least doc_id stays, a null id counting as largest; among
    equal ids the one with the least hash of its text, and any one of rows equal
    in both. Null and empty texts are one group. Empty in, empty out.
    """
    kept = docs.columns
    text = F.coalesce("text", F.lit(""))
    key = [F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id")]
    key += [F.xxhash64(text).alias("_print"), F.xxhash64(F.lit(1), text).alias("_more")]
    names = ["_none", "_id", "_print", "_more"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *key)
    grouped = _grouped(docs.select(F.col("doc_id"), *key, "text"), radius, size)
    first = grouped.groupBy("root").agg(F.min(F.struct(*names)).alias("k")).select("k.*")  # combined before the shuffle
    chosen = rows.join(materialise(first, "chosen"), names, "left_semi").dropDuplicates(names)
    return chosen.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)])


def hexadecimal(value: str = "fingerprint"):
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
