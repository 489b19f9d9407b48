"""Removal of repeated passages: fixed-block anchors.

A passage of ``window`` words holds at least one whole block of
``(window + 1) // 2`` words of any grid laid over the document it repeats. So

1. every document's non-overlapping blocks are indexed as anchors, and every
   rolling window of block size is a probe. Positions whose hash meets an anchor
   of another place, and the anchor's own position, are hits;
2. hits are extended: the full windows around them are compared over the whole
   corpus, and those that also start in a document with a smaller id are
   repeats. Their union is the maximal repeated passages.

Hashes travel in packed, sorted arrays, one per batch of documents and range of
hashes, not as rows. What repeats inside a batch is settled in the batch and
sent on once, so a passage that a third of all documents hold costs one entry
per batch, and nothing ever lists pairs. A group of the shuffle is a range of
hashes sized by the corpus (``GROUP_BYTES`` of text).

First-step hashes are cut to as many bits as keep chance hits rare; such a hit
only adds windows to the second step, which compares 80 bits of two
independent hashes of the whole window.

Texts that occur more than once are found first: a copy with a larger id than
another holds nothing but repeats and takes no part in the two steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import texts
from textloom.plans.shared_dir import materialise

WINDOW = 13
BATCH_WORDS = 3_000_000
GROUP_BYTES = 8 << 20
LAST_ID = (1 << 63) - 1  # where null ids sort

_PRINT = ["_print", "_more"]  # 128 bits for a text

_ENTRIES, _TABLE = 0, 1
_SHIPPED = "part bigint, batch bigint, kind int, data binary"
_SHIPPED_ARROW = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


# Packed arrays: a count, a width in bytes, and the low bytes of each value.


def _pack(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a).astype("<u8", copy=False)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out += [len(a).to_bytes(8, "little"), bytes([width]), a.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(n, width)
        out.append(wide.view("<u8").ravel())
        at += 9 + n * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


@dataclass
class Batch:
    """Word hashes of some documents of at least ``WINDOW`` words."""

    key: int
    hashes: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    prints: np.ndarray
    hits: list[np.ndarray]

    def table(self, found: np.ndarray) -> bytes:
        return _pack(self.first, self.ids.view(np.uint64), *self.prints.T.view(np.uint64), found)

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def _batches(source: Iterator[pa.RecordBatch], window: int) -> Iterator[Batch]:
    """Documents of a task in batches of about ``BATCH_WORDS`` words."""
    task, n = TaskContext.get().partitionId(), 0
    hashes, counts, ids, prints, hits, size = [], [], [], [], [], 0

    def batch() -> Batch:
        first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return Batch((task << 32) + n, np.concatenate(hashes), first, np.concatenate(ids), np.concatenate(prints), list(hits))

    for rows in source:
        names = rows.schema.names
        all_ids, *both = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_id", *_PRINT))
        all_prints = np.stack(both, axis=1)
        for words in texts.split(rows.column("text"), texts.SPACES):
            long = words.counts >= window
            if not long.any():
                continue
            hashes.append(texts.word_hashes(words)[np.repeat(long, words.counts)])
            counts.append(words.counts[long])
            ids.append(all_ids[words.rows][long])
            prints.append(all_prints[words.rows][long])
            if "_found" in names:
                found = rows.column("_found")[words.rows.start : words.rows.stop].to_pylist()
                hits += [_unpack(f)[0].astype(np.int64) for f, w in zip(found, long, strict=True) if w]
            size += int(counts[-1].sum())
            if size >= BATCH_WORDS:
                yield batch()
                n, size = n + 1, 0
                for held in (hashes, counts, ids, prints, hits):
                    held.clear()
    if size:
        yield batch()


def _shipments(batch: Batch, key: np.ndarray, bits: int, parts: int, pack: Callable, found: np.ndarray) -> pa.RecordBatch:
    """One row per range of the ascending ``key``, and one with the batch's documents."""
    part = ((key >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(key)] if len(key) else []
    rows = [(int(part[a]), batch.key, _ENTRIES, pack(slice(a, b))) for a, b in zip(edges, edges[1:], strict=False)]
    rows.append((batch.key % parts, batch.key, _TABLE, batch.table(found)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SHIPPED_ARROW.types, strict=True)], schema=_SHIPPED_ARROW)


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(starts, append=n)


# Step 1: blocks as anchors, rolling windows as probes.


def _probe(window: int, bits: int, parts: int) -> Callable:
    block = (window + 1) // 2

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(source, window):
            at = texts.whole_windows(batch.first, block)
            key = texts.window_hashes(batch.hashes, block)[at] >> np.uint64(64 - bits)
            counts = np.diff(batch.first) - block + 1
            anchor = (at - np.repeat(batch.first[:-1], counts)) % block == 0
            order = np.argsort(key, kind="stable")
            key, at, anchor = key[order], at[order], anchor[order]
            starts = _groups(key)
            # in several documents of the batch: settled here, and one is sent on for all
            sizes, doc = _sizes(starts, len(key)), batch.document_of(at)
            shared = np.repeat(np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts), sizes)
            local = at[shared]
            anchor = np.repeat(np.logical_or.reduceat(anchor, starts), sizes)
            sent = ~shared
            sent[starts] = True
            key, where = key[sent], at[sent] * 2 + anchor[sent]

            def pack(s: slice, key=key, where=where) -> bytes:
                return _pack(_steps(key[s]), where[s])

            yield _shipments(batch, key, bits, parts, pack, local)

    return work


def _gather(frame: pd.DataFrame) -> tuple[list[list[np.ndarray]], np.ndarray, list[int], list[tuple]]:
    """Unpacked shipments, whose they are, and the rows that only pass through."""
    own = frame[frame["kind"] == _ENTRIES]
    sent = [_unpack(d) for d in own["data"]]
    source = np.repeat(np.arange(len(sent)), [len(s[0]) for s in sent])
    rest = frame[frame["kind"] == _TABLE]
    return sent, source, own["batch"].tolist(), list(zip(rest["batch"], rest["kind"], rest["data"], strict=True))


def _answer(batches: list[int], source: np.ndarray, found: np.ndarray, passed: list[tuple]) -> pd.DataFrame:
    order = np.argsort(source, kind="stable")
    source, found = source[order], found[order]
    cuts = np.searchsorted(source, np.arange(len(batches) + 1))
    rows = [(b, _ENTRIES, _pack(found[x:y])) for b, x, y in zip(batches, cuts, cuts[1:], strict=False) if y > x]
    return pd.DataFrame(rows + passed, columns=["batch", "kind", "data"])


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """Positions whose block hash is an anchor and occurs in more places."""
    sent, source, batches, passed = _gather(frame)
    if not sent:
        return _answer([], source, source, passed)
    key = np.concatenate([np.cumsum(s[0], dtype=np.uint64) for s in sent])
    where = np.concatenate([s[1] for s in sent])
    order = np.argsort(key, kind="stable")
    key, where, source = key[order], where[order], source[order]
    starts = _groups(key)
    n = _sizes(starts, len(key))
    hit = np.repeat((n > 1) & (np.maximum.reduceat(where & np.uint64(1), starts) > 0), n)
    return _answer(batches, source[hit], (where >> np.uint64(1))[hit], passed)


# Step 2: the windows around hits, over the whole corpus.


def _extend(window: int, parts: int) -> Callable:
    block = (window + 1) // 2

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(source, window):
            base = np.repeat(batch.first[:-1], [len(h) for h in batch.hits])
            hits = base + np.concatenate(batch.hits)
            first = np.maximum(hits - (window - block), base)
            near = texts.covered(len(batch.hashes), first, hits - first + 1)
            whole = np.zeros(len(near), bool)
            whole[texts.whole_windows(batch.first, window)] = True
            at = np.flatnonzero(near & whole)
            key = texts.window_hashes(batch.hashes, window, seed=1)[at]
            second = texts.window_hashes(batch.hashes, window, seed=2)[at] >> np.uint64(48)
            order = np.lexsort((second, key))
            key, second, at = key[order], second[order], at[order]
            ids = batch.ids[batch.document_of(at)]
            starts = _groups(key, second) if len(key) else np.zeros(0, np.int64)
            least = np.repeat(np.minimum.reduceat(ids, starts), _sizes(starts, len(key))) if len(key) else ids
            repeat, sent = at[ids > least], ids == least
            key, second, at, ids = key[sent], second[sent], at[sent], ids[sent]

            def pack(s: slice, key=key, second=second, at=at, ids=ids) -> bytes:
                names, which = np.unique(ids[s], return_inverse=True)
                return _pack(_steps(key[s]), second[s], at[s], which, names.view(np.uint64))

            yield _shipments(batch, key, 64, parts, pack, repeat)

    return work


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows that also start in a document with a smaller id."""
    sent, source, batches, passed = _gather(frame)
    if not sent:
        return _answer([], source, source, passed)
    key = np.concatenate([np.cumsum(s[0], dtype=np.uint64) for s in sent])
    second, at = (np.concatenate([s[i] for s in sent]) for i in (1, 2))
    ids = np.concatenate([_signed(s[4])[s[3].astype(np.int64)] for s in sent])
    order = np.lexsort((second, key))
    key, second, at, ids, source = key[order], second[order], at[order], ids[order], source[order]
    starts = _groups(key, second)
    repeat = ids > np.repeat(np.minimum.reduceat(ids, starts), _sizes(starts, len(key)))
    return _answer(batches, source[repeat], at[repeat], passed)


def _by_document(frame: pd.DataFrame) -> pd.DataFrame:
    """What was found in a batch, per document, as ascending word positions."""
    first, ids, print_, more, local = _unpack(frame.loc[frame["kind"] == _TABLE, "data"].iloc[0])
    found = [_unpack(d)[0] for d in frame.loc[frame["kind"] == _ENTRIES, "data"]]
    at = np.unique(np.concatenate([local, *found])).astype(np.int64)
    first = first.astype(np.int64)
    doc = np.searchsorted(first, at, "right") - 1
    own = np.unique(doc)
    cuts = np.searchsorted(doc, own, "left").tolist() + [len(at)]
    data = [_pack(at[a:b] - first[d]) for d, a, b in zip(own, cuts, cuts[1:], strict=False)]
    return pd.DataFrame({"_own": _signed(ids)[own], "_print": _signed(print_)[own], "_more": _signed(more)[own], "_found": data})


def _round(shipped: DataFrame, meet: Callable) -> DataFrame:
    met = shipped.groupBy("part").applyInPandas(meet, "batch bigint, kind int, data binary")
    found = met.groupBy("batch").applyInPandas(_by_document, "_own bigint, _print bigint, _more bigint, _found binary")
    # rows left with equal texts have equal ids too and have found the same; either will do
    return found.groupBy(*_PRINT).agg(F.max("_own").alias("_own"), F.max("_found").alias("_found"))


def _cut(window: int) -> Callable:
    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            n_words, n_removed, kept = [], [], []
            for text, found, copy in zip(rows.column("text"), rows.column("_found"), rows.column("_copy"), strict=True):
                words = text.as_py().encode().split()
                n_words.append(len(words))
                if copy.as_py():
                    words = words if len(words) < window else []
                elif (found := found.as_py()) is not None:
                    gone = texts.covered(len(words), _unpack(found)[0].astype(np.int64), window)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            arrays = [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return work


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs(doc_id, text)``.

    ``kept`` is the text without the words of any window of ``window`` words
    that also starts in a document with a smaller id, its words joined by one
    space. Windows are judged on the input. A null text has no words. A null
    id is larger than any; equal ids are not smaller than each other, so rows
    repeated with their id are left alone. Other columns are ignored.

    ``docs`` should be a stored table: a rerun task must see its rows in the
    same order.
    """
    id_type = docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64(text).alias("_print"),
        F.xxhash64(F.lit(1), text).alias("_more"),
        text.alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, total // GROUP_BYTES)
    bits = min(64, max(36, total.bit_length() + 10))
    copied = rows.groupBy(*_PRINT).agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    copied = materialise(copied.select(*_PRINT, "_least"), "copied-texts")
    # texts are dealt out by their print once: both joins below read the same columns in the same way
    first_only = rows.join(copied, _PRINT, "left").where(~_is_copy()).select(*rows.columns)
    hits = _round(first_only.mapInArrow(_probe(window, bits, parts), _SHIPPED), _meet)
    # not an equality: that would become a key of the join, and the texts would be dealt out in another way
    extended = rows.join(hits.hint("shuffle_hash"), _PRINT).where("_id <= _own AND _id >= _own")
    repeats = _round(extended.select(*rows.columns, "_found").mapInArrow(_extend(window, parts), _SHIPPED), _settle)
    known = repeats.drop("_own").join(copied, _PRINT, "full")
    cut = rows.join(known.hint("shuffle_hash"), _PRINT, "left").withColumn("_copy", _is_copy()).drop("_least")
    schema = f"doc_id {id_type.simpleString()}, n_words bigint, n_removed bigint, kept string"
    return cut.mapInArrow(_cut(window), schema)


def _is_copy() -> Column:
    return F.coalesce(F.col("_id") > F.col("_least"), F.lit(False))
