"""Benchmark decontamination: a prefix-filtered set join.

A benchmark window (``window`` consecutive item words, or a shorter item's
words) is the set of its short shingles. To contain the whole window a document
must contain every one of them, so at containment one the necessary prefix, in
order of rarity, is the rarest shingle alone. The corpus is read once to count
how often each shingle of the benchmark occurs in it; a second time, document
positions are joined with the prefix shingles. A position leaves one possible
place for the window (positional bound); it must lie inside the document
(length bound); and the words there are compared one by one.

The benchmark is the small side. It is taken in blocks of ``WINDOWS_AT_ONCE``
rows, so what is sent to the tasks is bounded whatever its size; with several
blocks documents pass through one filter after the other, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import texts
from textloom.plans.shared_dir import materialise

WINDOW = 10
SHINGLE = 3
WINDOWS_AT_ONCE = 100_000

_MARK_BITS = 20


@dataclass
class Block:
    """Some windows: distinct word sequences, their word hashes and items."""

    words: list[bytes]
    hashes: list[np.ndarray]
    items: list[list[str]]

    @classmethod
    def of(cls, rows: list) -> Block:
        items: dict[bytes, set[str]] = {}
        for r in rows:
            items.setdefault(r["window"].encode(), set()).update([] if r["item_id"] is None else [r["item_id"]])
        words = sorted(items)
        hashes = []
        for part in texts.split(pa.array([w.decode() for w in words], pa.string()), texts.SPACES):
            h = texts.word_hashes(part)
            hashes += [h[a:b] for a, b in zip(part.first, part.first[1:], strict=False)]
        return cls(words, hashes, [sorted(items[w]) for w in words])

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: every window's shingle hashes, whose they are and where in the window."""
        out: dict[int, list] = {}
        for i, h in enumerate(self.hashes):
            size = min(SHINGLE, len(h))
            own = texts.window_hashes(h, size)
            out.setdefault(size, []).append((own, np.full(len(own), i), np.arange(len(own))))
        return {size: tuple(np.concatenate(c) for c in zip(*rows, strict=True)) for size, rows in out.items()}


class _Member:
    """Where in an array values of a sorted set occur; a bit table spares most look-ups."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.marks = np.zeros(1 << _MARK_BITS, bool)
        self.marks[values >> np.uint64(64 - _MARK_BITS)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.marks[x >> np.uint64(64 - _MARK_BITS)])
        which = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        same = self.values[which] == x[at]
        return at[same], which[same]


def _split(column: pa.Array) -> Iterator[texts.Words]:
    return texts.split(column, texts.NOT_ALNUM, lower=True)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(item_id string, window)`` of ``items(item_id, text)``; words joined by a space."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for part in _split(rows.column("text")):
                raw = part.data.tobytes()
                words = [raw[a:b] for a, b in zip(part.starts.tolist(), part.ends.tolist(), strict=True)]
                out, own = [], []
                names = rows.column("item_id")[part.rows.start : part.rows.stop].to_pylist()
                for name, a, b in zip(names, part.first.tolist(), part.first[1:].tolist(), strict=False):
                    found = [b" ".join(words[i : min(i + window, b)]).decode() for i in range(a, max(a + 1, b - window + 1)) if b > a]
                    out += found
                    own += [name] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(out, pa.string())], names=["item_id", "window"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(work, "item_id string, window string").distinct()


def _rarity(texts_only: DataFrame, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle occurs in the corpus; counted in full, combined per task."""
    sent = texts_only.sparkSession.sparkContext.broadcast(tokens)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = {size: _Member(v) for size, v in sent.value.items()}
        counts = {size: np.zeros(len(v), np.int64) for size, v in sent.value.items()}
        for rows in source:
            for part in _split(rows.column("text")):
                hashes = texts.word_hashes(part)
                for size, member in members.items():
                    at = texts.whole_windows(part.first, size)
                    _, which = member.find(texts.window_hashes(hashes, size)[at])
                    counts[size] += np.bincount(which, minlength=len(counts[size]))
        for size, c in counts.items():
            which = np.flatnonzero(c)
            arrays = [pa.array(np.full(len(which), size), pa.int32()), pa.array(which, pa.int64()), pa.array(c[which], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["size", "token", "n"])

    found = texts_only.mapInArrow(work, "size int, token bigint, n bigint").groupBy("size", "token").agg(F.sum("n").alias("n"))
    out = {size: np.zeros(len(v), np.int64) for size, v in tokens.items()}
    for r in found.collect():  # at most one row per shingle of the block
        out[r["size"]][r["token"]] = r["n"]
    return out


@dataclass
class Prefixes:
    """Per shingle size: the prefix shingles, and the windows and offsets each stands for."""

    member: _Member
    begin: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _prefixes(block: Block, corpus: DataFrame) -> dict[int, Prefixes]:
    shingles = block.shingles()
    tokens = {size: np.unique(s[0]) for size, s in shingles.items()}
    rarity = _rarity(corpus, tokens)
    out = {}
    for size, (own, window, offset) in shingles.items():
        token = np.searchsorted(tokens[size], own)
        order = np.lexsort((offset, rarity[size][token], window))  # the rarest first, the leftmost of equals
        rarest = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
        rarest = rarest[np.argsort(token[rarest], kind="stable")]
        used, begin = np.unique(token[rarest], return_index=True)
        begin = np.append(begin, len(rarest))
        out[size] = Prefixes(_Member(tokens[size][used]), begin, window[rarest], offset[rarest])
    return out


def _occurrences(part: texts.Words, hashes: np.ndarray, block: Block, prefixes: dict[int, Prefixes]) -> tuple[np.ndarray, np.ndarray]:
    """Where which windows occur, as first word and window; verified word by word."""
    found_at, found = [], []
    lengths = np.array([len(h) for h in block.hashes])
    raw = part.data.tobytes()
    for size, p in prefixes.items():
        at, which = p.member.find(texts.window_hashes(hashes, size))
        n = np.diff(p.begin)[which]
        window = p.window[texts.ranges(p.begin[:-1][which], n)]
        start = np.repeat(at, n) - p.offset[texts.ranges(p.begin[:-1][which], n)]
        doc = np.searchsorted(part.first, np.repeat(at, n), "right") - 1
        fits = (start >= part.first[doc]) & (start + lengths[window] <= part.first[doc + 1])
        start, window = start[fits], window[fits]
        for k in np.unique(lengths[window]):
            own = lengths[window] == k
            s, w = start[own], window[own]
            names, which = np.unique(w, return_inverse=True)
            want = np.stack([block.hashes[i] for i in names]) if len(names) else np.zeros((0, k), np.uint64)
            same = np.ones(len(s), bool)
            for j in range(k):
                same &= hashes[s + j] == want[which, j]
            s, w = s[same], w[same]
            exact = [
                b" ".join(raw[a:b] for a, b in zip(part.starts[x : x + k].tolist(), part.ends[x : x + k].tolist(), strict=True)) == block.words[i]
                for x, i in zip(s.tolist(), w.tolist(), strict=True)
            ]
            found_at.append(s[exact])
            found.append(w[exact])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at).astype(np.int64), np.concatenate(found)


_FOUND = "_spans binary, _items array<string>, _n_words bigint, _n_hit bigint"


def _filter(docs: DataFrame, text: str, block: Block | None, prefixes: dict[int, Prefixes], first: bool, drop: str) -> DataFrame:
    """Pass documents through one block; the columns ``_FOUND`` hold what the blocks so far have found."""
    kept = [c for c in docs.columns if not c.startswith("_") and c != drop]
    sent = docs.sparkSession.sparkContext.broadcast((block, prefixes))

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, prefixes = sent.value
        for rows in source:
            spans, items, n_words, n_hit = [], [], [], []
            for part in _split(rows.column(text)):
                start, window = np.zeros((2, 0), np.int64)
                if block is not None and len(part.starts):
                    start, window = _occurrences(part, texts.word_hashes(part), block, prefixes)
                order = np.argsort(start, kind="stable")
                start, window = start[order], window[order]
                cuts = np.searchsorted(start, part.first)
                for d in range(len(part.first) - 1):
                    own = slice(cuts[d], cuts[d + 1])
                    n = int(part.first[d + 1] - part.first[d])
                    n_words.append(n)
                    if own.start == own.stop:
                        spans.append(b"")
                        items.append([])
                        n_hit.append(0)
                        continue
                    used = np.unique(window[own])
                    pairs = np.stack([start[own] - part.first[d], [len(block.hashes[i]) for i in window[own]]], axis=1)
                    spans.append(pairs.astype("<i8").tobytes())
                    items.append(sorted({x for i in used for x in block.items[i]}))
                    n_hit.append(int(texts.covered(n, pairs[:, 0], pairs[:, 1]).sum()))
            if not first:
                for i, (b, x) in enumerate(zip(rows.column("_spans").to_pylist(), rows.column("_items").to_pylist(), strict=True)):
                    if b:
                        spans[i] += b
                        items[i] = sorted({*items[i], *x})
                        pairs = np.frombuffer(spans[i], "<i8").reshape(-1, 2)
                        n_hit[i] = int(texts.covered(n_words[i], pairs[:, 0], pairs[:, 1]).sum())
            out = [rows.column(c) for c in kept] + [pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            out += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "_spans", "_items", "_n_words", "_n_hit"])

    schema = T.StructType([*docs.select(*kept).schema, *T.StructType.fromDDL(_FOUND)])
    return docs.mapInArrow(work, schema)


def contained(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, name: str = "containment", with_text: bool = True
) -> DataFrame:
    """``docs`` with a struct column ``name``: ``n_words, n_hit, n_items, items``.

    Words are runs of letters, digits and non-ASCII characters of the
    lower-cased text (A-Z). ``n_hit`` counts document words inside an
    occurrence of an item's window of ``window`` words, a shorter item being
    one window; ``items`` are the ids of items with such windows, as sorted
    strings, each once. Null and empty texts have no words, and items without
    words no windows. An item without id counts in ``n_hit`` only. Other
    columns of ``docs`` are kept as they are, save one called ``name``, which
    is replaced, and ``text`` unless ``with_text``; those of ``items`` are
    ignored. Repeated rows come out as often as they went in.
    """
    windows = materialise(item_windows(items, window), "item-windows")
    blocks = max(1, -(-windows.count() // WINDOWS_AT_ONCE))
    kept = [c for c in docs.columns if c != name]
    inside = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    text = f"c{kept.index('text')}"
    corpus = inside.select(F.col(text).alias("text"))
    out = inside
    for k in range(blocks):
        # rows of a window may fall into several blocks; what they find is united
        rows = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == k).collect()
        block = Block.of(rows) if rows else None
        prefixes = _prefixes(block, corpus) if block else {}
        out = _filter(out, text, block, prefixes, k == 0, text if k == blocks - 1 and not with_text else "")
    found = F.struct(
        F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.col("_items").alias("items")
    )
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if with_text or c != "text"], found.alias(name))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns."""
    name = "_containment"
    while name in docs.columns:
        name += "_"
    return contained(docs, items, window, name).where(F.col(f"{name}.n_hit") == 0).select(*[f"`{c}`" for c in docs.columns])
