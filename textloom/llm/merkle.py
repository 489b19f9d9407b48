"""Merkle manifest of a table: a postorder append log built by aligned builders.

A tree of ``ARITY`` children per node stands over the leaves of each group, in
order, and one over the groups' roots. Builders own aligned runs of ``ARITY **
HEIGHT`` leaves. A builder writes a node the moment its last child is written,
so its log is the postorder of its subtree, and nothing is ever moved. Roots of
builders are the leaves of the next storey, built in the same way, until one
builder is left per tree.

Subtree sizes are known from the number of leaves, so the place of a node in the
log is closed arithmetic (``postorder``): a proof reads the siblings of its path
straight from the log. Proofs of a storey are put before those of the storey
below it, one builder's log and one path from above at a time.

No task holds more than one builder's leaves, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.order import numbered
from textloom.plans.shared_dir import materialise

ARITY = 8
HEIGHT = 4  # levels of a builder
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32  # bytes


def encoded(fields: list[Column]) -> Column:
    """Fields as one text that can be read in one way only: ``-`` for null, else byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the encoded fields, as bytes."""
    return F.unhex(F.sha2(encoded(fields).cast("binary"), 256))


def hashed(digests: bytes) -> bytes:
    """The parent of digests laid one after the other: SHA-256 of their lower-case hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def levels_of(leaves: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree that ends where one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // arity), levels + 1
    return levels


def postorder(level: int, index: int, leaves: int, levels: int, arity: int = ARITY) -> int:
    """Place in the log of node ``index`` of a level, in a tree over ``leaves`` leaves.

    Before it stand the leaves up to its last one, the nodes above those that
    ended with them, below its own level all that have begun, and above it only
    those that were full before its first leaf.
    """
    last = min((index + 1) * arity**level, leaves)
    below = sum(-(-last // arity**k) for k in range(level + 1))
    above = sum(index // arity ** (k - level) for k in range(level + 1, levels + 1))
    return below + above - 1


def append_log(leaves: list[bytes], levels: int, arity: int = ARITY) -> bytes:
    """Digests of a subtree in the order in which they are complete."""
    out: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def complete(level: int, digest: bytes, last: bool) -> None:
        out.append(digest)
        if level < levels:
            run = open_runs[level]
            run.append(digest)
            if len(run) == arity or last:
                parent = hashed(b"".join(run))
                run.clear()
                complete(level + 1, parent, last)

    for i, leaf in enumerate(leaves):
        complete(0, leaf, i == len(leaves) - 1)
    return b"".join(out)


def path_in_log(log: bytes, index: int, leaves: int, levels: int, arity: int = ARITY) -> list[dict]:
    """Siblings of a leaf's path, level by level: the node's place in its run, and the run's other digests."""
    path, count = [], leaves
    for level in range(levels):
        first = index // arity * arity
        run = [i for i in range(first, min(first + arity, count)) if i != index]
        at = [postorder(level, i, leaves, levels, arity) * DIGEST for i in run]
        path.append({"place": index - first, "siblings": b"".join(log[a : a + DIGEST] for a in at)})
        index, count = index // arity, -(-count // arity)
    return path


_PATH = "array<struct<place:int,siblings:binary>>"


def _builder(arity: int, height: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leaves = frame.sort_values("rank")["digest"].tolist()
        alone = frame["n"].iloc[0] <= arity**height
        levels = levels_of(len(leaves), arity) if alone else height
        log = append_log(leaves, levels, arity)
        return pd.DataFrame([(key[0], key[1], frame["n"].iloc[0], len(leaves), levels, log, log[-DIGEST:])], columns=_LOG_COLUMNS)

    return work


_LOG_COLUMNS = ["tree", "builder", "n", "leaves", "levels", "log", "digest"]
_LOG = "tree string, builder bigint, n bigint, leaves int, levels int, log binary, digest binary"


def build(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> list[DataFrame]:
    """Logs of all trees over ``leaves(tree, rank, n, digest)``, a stored table per storey, the lowest first.

    ``rank`` numbers the leaves of a tree from 0 and ``n`` counts them. A log
    row is one builder's: ``tree, builder, n, leaves, levels, log, digest``. In
    the last table every tree has one builder or none, whose ``digest`` is the
    tree's root. Trees of one builder are not in the tables above it.
    """
    whole = arity**height
    storeys = []
    while True:
        groups = leaves.withColumn("builder", F.floor(F.col("rank") / whole)).groupBy("tree", "builder")
        storeys.append(materialise(groups.applyInPandas(_builder(arity, height), _LOG), "merkle-log"))
        more = storeys[-1].where(F.col("n") > whole)
        if not more.limit(1).count():
            return storeys
        leaves = more.select("tree", F.col("builder").alias("rank"), F.ceil(F.col("n") / whole).alias("n"), "digest")


def roots(storeys: list[DataFrame], arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """``tree, digest``: the root of every tree."""
    done = [s.where(F.col("n") <= arity**height).select("tree", "digest") for s in storeys]
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _reader(arity: int, height: int, columns: list[str]) -> Callable:
    """Rows of a builder's leaves with their path: inside the builder, then the builder's own."""

    def work(rows: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in [*columns, "path"]})
        built = log.iloc[0]
        above = [] if built["above"] is None else [dict(x) for x in built["above"]]
        first = int(built["builder"]) * arity**height
        own = [path_in_log(built["log"], int(r) - first, int(built["leaves"]), int(built["levels"]), arity) for r in rows["rank"]]
        out = rows[columns].copy()
        out["path"] = [p + above for p in own]
        return out

    return work


def paths(leaves: DataFrame, storeys: list[DataFrame], arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """``leaves(tree, rank, ...)`` with ``path``: siblings from the leaf up to the root of its tree.

    ``path`` has a struct per level: ``place`` of the node among its run, and
    ``siblings``, the run's other digests from left to right.
    """
    whole = arity**height
    above = None
    for storey in reversed(range(len(storeys))):
        logs = storeys[storey]
        if above is None:
            logs = logs.withColumn("above", F.lit(None).cast(_PATH))
        else:
            logs = logs.join(above.select("tree", F.col("rank").alias("builder"), F.col("path").alias("above")), ["tree", "builder"], "left")
        rows = leaves if storey == 0 else storeys[storey - 1].where(F.col("n") > whole).select("tree", F.col("builder").alias("rank"))
        rows = rows.withColumn("builder", F.floor(F.col("rank") / whole))
        kept = [c for c in rows.columns if c != "builder"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "builder") + f", path {_PATH}"
        pairs = rows.groupBy("tree", "builder").cogroup(logs.groupBy("tree", "builder"))
        above = pairs.applyInPandas(_reader(arity, height, kept), schema)
        if storey:
            above = materialise(above, "merkle-paths")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf (bytes) and its path."""
    hex_of = lambda b: F.lower(F.hex(b))

    def step(acc: Column, level: Column) -> Column:
        left = level["place"] * DIGEST
        own = F.concat(
            hex_of(F.substring(level["siblings"], F.lit(1), left)), hex_of(acc), hex_of(F.substring(level["siblings"], left + 1, F.octet_length(level["siblings"])))
        )
        return F.unhex(F.sha2(own.cast("binary"), 256))

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Lower-case hex SHA-256 of all siblings of a path, as hex text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.lower(F.hex(s["siblings"]))), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: ``order``, ``leaf``, ``other``, ``subroot``, ``root``, ``path`` and ``log_position``.

    ``leaf`` is the digest of the row's ``fields``; leaves of a ``group`` stand
    in ascending ``order``, nulls first, rows equal in it by their digest.
    ``subroot`` is the root of the group's tree, ``root`` that of the tree over
    the subroots by group (null first, then by its UTF-8 bytes). ``path`` leads
    from the leaf via ``subroot`` to ``root``; ``log_position`` is the leaf's
    place in the postorder of its group's tree. ``other`` is the digest of the
    fields with ``changed``, an expression over ``docs``, for the last of
    ``fields``; null where ``changed`` is not given. Digests are bytes.

    Repeated rows are leaves of their own; null and empty texts differ. Other
    columns are ignored. A single group's subroot is the root. Empty in, empty
    out: no root.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    tree = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))  # null before any other
    other = F.lit(None).cast("binary") if changed is None else leaf_digest([*columns[:-1], changed])
    rows = docs.select(tree.alias("tree"), F.col(f"`{order}`").alias("key"), leaf_digest(columns).alias("digest"), other.alias("other"))
    rows = materialise(rows, "leaves").withColumn("_any", F.xxhash64(F.monotonically_increasing_id()))  # parts equal rows
    leaves = numbered(rows, [F.col(c) for c in ("tree", "key", "digest", "_any")], "tree")
    leaves = materialise(leaves.drop("_any"), "numbered-leaves")
    counts = materialise(leaves.groupBy("tree").agg(F.count("*").alias("n")), "trees")

    logs = build(leaves.join(counts, "tree").select("tree", "rank", "n", "digest"))
    tops = materialise(roots(logs), "subroots")
    upper = numbered(tops.select(F.lit("").alias("all"), "tree", "digest"), [F.col("all"), F.col("tree")], "all")
    upper = materialise(upper.join(upper.groupBy("all").agg(F.count("*").alias("n")), "all"), "numbered-subroots")
    over = build(upper.select(F.col("all").alias("tree"), "rank", "n", "digest"))
    root = roots(over).select("tree", F.col("digest").alias("root"))
    top_paths = paths(upper.select(F.col("all").alias("tree"), "rank", F.col("tree").alias("group"), F.col("digest").alias("subroot")), over)
    top_paths = materialise(top_paths.join(root, "tree").select(F.col("group").alias("tree"), "subroot", "root", F.col("path").alias("top")), "subroot-paths")

    found = paths(leaves, logs).join(counts, "tree").join(top_paths, "tree")
    return found.select(
        F.col("key").alias(order),
        F.col("digest").alias("leaf"),
        "other",
        "subroot",
        "root",
        F.concat("path", "top").alias("path"),
        leaf_position(F.col("rank")).alias("log_position"),
    )


def leaf_position(rank: Column, arity: int = ARITY, levels: int = 20) -> Column:
    """``postorder`` of a leaf: it stands behind the leaves before it and the nodes they have filled."""
    return sum((F.floor(rank / arity**k) for k in range(1, levels + 1)), rank)
