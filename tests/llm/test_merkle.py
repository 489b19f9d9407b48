import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, arity):
    """Levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, i, arity):
    out = []
    for level in levels[:-1]:
        first = i // arity * arity
        out.append((i - first, [x for j, x in enumerate(level[first : first + arity]) if first + j != i]))
        i //= arity
    return out


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_postorder_places(arity):
    for n in [*range(1, 40), 64, 65]:
        names = [bytes([i]) * merkle.DIGEST for i in range(n)]
        for levels in {merkle.levels_of(n, arity), merkle.levels_of(n, arity) + 1}:
            log = merkle.append_log(names, levels, arity)
            nodes, level = [], names
            for k in range(levels + 1):
                nodes += [(k, i, d) for i, d in enumerate(level)]
                level = [merkle.hashed(b"".join(level[i : i + arity])) for i in range(0, len(level), arity)]
            places = [merkle.postorder(k, i, n, levels, arity) for k, i, _ in nodes]
            assert sorted(places) == list(range(len(nodes)))
            for place, (_, _, digest) in zip(places, nodes, strict=True):
                assert log[place * merkle.DIGEST : (place + 1) * merkle.DIGEST] == digest


def test_builders_of_several_storeys(spark):
    arity, height = 2, 1
    sizes = {"a": 1, "b": 2, "c": 13, "d": 16}
    rows = [(t, i, n, bytes.fromhex(h(f"{t}{i}"))) for t, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, rank bigint, n bigint, digest binary").repartition(5)
    logs = merkle.build(leaves, arity, height)
    root = {r.tree: r.digest.hex() for r in merkle.roots(logs, arity, height).collect()}
    found = merkle.paths(leaves, logs, arity, height).withColumn("up", merkle.folded(F.col("digest"), F.col("path"))).collect()
    assert len(logs) == 4 and len(found) == len(rows)
    for r in found:
        levels = tree([h(f"{r.tree}{i}") for i in range(sizes[r.tree])], arity)
        assert root[r.tree] == levels[-1][0] == r.up.hex()
        got = [(x.place, [x.siblings[i : i + 32].hex() for i in range(0, len(x.siblings), 32)]) for x in r.path]
        assert got == siblings(levels, r["rank"], arity)


ROWS = [
    (5, "a", None, 3, "x"), (None, None, "en", None, None), (7, "é", "en", 1, ""), (7, "é", "en", 1, ""), (7, "b", "en", 2, "ÄBC"), (1, "a", "", 0, "T" * 70_000),
    *[(100 + i, "s", "fr", i, f"Text {i}") for i in range(75)],
]


def test_manifest(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("rank", F.lit("clash"))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: h("".join(field(row[i]) for i in (0, 1, 2, 3, 4)))
    groups = {}
    for row in ROWS:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))], 8) for g in order}
    top = tree([trees[g][-1][0] for g in order], 8)
    want = []
    for j, g in enumerate(order):
        for i, own in enumerate(trees[g][0]):
            path = siblings(trees[g], i, 8) + siblings(top, j, 8)
            want.append((own, trees[g][-1][0], top[-1][0], h("".join(x for _, s in path for x in s))))
    found = merkle.manifest(docs, changed=F.lower("text")).withColumn("proof", merkle.proof_digest(F.col("path")))
    found = found.withColumn("up", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("down", merkle.folded(F.col("other"), F.col("path"))).collect()
    assert sorted((r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof) for r in found) == sorted(want)
    assert all(r.up == r.root for r in found)
    low = {leaf(r) for r in ROWS if r[4] is None or r[4].lower() == r[4]}
    assert all((r.down == r.root) == (r.leaf.hex() in low) for r in found)
    french = sorted((r.doc_id, r.log_position) for r in found if (r.doc_id or 0) >= 100)
    assert [p for _, p in french] == [merkle.postorder(0, i, 75, 3) for i in range(75)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(docs).collect() == []
