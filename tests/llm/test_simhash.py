"""SimHash near duplicates against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import components, simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=4):
    best = list(range(len(ids)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                best[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, u string")
    found = simhash.near_duplicates(docs).withColumn("fingerprint", simhash.hexadecimal()).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = zip([r[0] for r in rows], prints, brute_components([r[0] for r in rows], prints), strict=True)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((d, f"{p:016x}", c) for d, p, c in want), key=key)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    check(spark, [
        (1, None, "x", None), (2, "", None, "y"), (3, " \n\t", None, None), (4, "One", None, None), (5, "one", None, None),
        (None, "one two", None, None), (None, None, None, None), (7, long, None, None), (8, long + " more", None, None),
        (8, long, None, None), (9, "a b c d", None, None), (9, "A\x0bB c  d", None, None), (10, "naïve É  x", None, None),
    ])


def test_near_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        words = [f"t{x}" for x in rng.integers(0, 500, rng.integers(5, 400))]
        for c in range(int(rng.integers(1, 8))):
            own = list(words)
            if c:
                own[int(rng.integers(len(own)))] = f"new{c}"
            rows.append((len(rows), " ".join(own), None, None))
    check(spark, rows)


@pytest.mark.parametrize("at_once", [1 << 21, 500])
def test_no_link_is_lost(spark, monkeypatch, at_once):
    rng = np.random.default_rng(1)
    centres = rng.integers(-(1 << 63), 1 << 63, 30)
    values = set()
    for c in centres.tolist():
        for _ in range(12):
            v = c & (1 << 64) - 1
            for b in rng.integers(0, 64, int(rng.integers(0, 7))).tolist():
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    # the pairs a group of all values meets in, with and without further cuts
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    label = np.arange(len(values))
    array = np.array(values, np.uint64)
    for a, b in simhash._stars(array, np.full(len(values), 2), 64 if at_once > 1000 else 16):
        label = simhash.forest(len(values), np.r_[a, label], np.r_[b, np.arange(len(values))])
    if at_once > 1000:
        assert label.tolist() == brute_components(list(range(len(values))), values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"))
    roots = {r.node: r.root for r in components.component_roots(edges).collect()}
    want = brute_components(signed, values)
    assert [roots.get(v, v) for v in signed] == want


@pytest.mark.parametrize("sent", [100_000, 0])
def test_crowded_prefixes_are_dealt_out_again(spark, monkeypatch, sent):
    """Variations of one template: no task takes more than a crowd, no link is lost, by brute force."""
    rng = np.random.default_rng(4)
    template = int(rng.integers(1 << 62))
    values = {template}
    while len(values) < 250:  # most share all leading bits with the template or differ in some anywhere
        flips = rng.integers(0, 64 if len(values) % 3 else 40, int(rng.integers(1, 8)))
        values.add(template ^ sum(1 << int(b) for b in set(flips.tolist())))
    values |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    values = sorted(values)
    taken, meet = [], simhash._meet
    for name, value in {"CROWD": 60, "MOST_BITS": 18, "SENT_CROWDS": sent, "VARIANTS_AT_ONCE": 1 << 17}.items():
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(simhash, "_meet", lambda radius, bits: taken.append(bits) or meet(radius, bits))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint").repartition(4)
    roots = {r.node: r.root for r in components.component_roots(simhash.linked_fingerprints(df)).collect()}
    assert len(taken) > 1 and taken == sorted(set(taken))
    want = brute_components(values, values)
    least = {}
    for v, c in zip(signed, want, strict=True):
        least.setdefault(roots.get(v, v), set()).add(c)
    assert all(len(c) == 1 for c in least.values()) and len(least) == len(set(want))


def test_components_of_paths_and_hubs(spark):
    path = [(i + 1, i) for i in range(60)]
    hub = [(1000 + i, 500) for i in range(200)]
    edges = spark.createDataFrame([*path, *hub, (7, 7), (3, 2), (900, 901)], "u bigint, v bigint")
    roots = {r.node: r.root for r in components.component_roots(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 500 for i in range(200)}, 901: 900}
    assert components.component_roots(edges.where("u > 5000")).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.hexadecimal() is not None and F is not None
