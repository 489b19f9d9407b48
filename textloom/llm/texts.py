"""Words and word hashes of a column of texts, in whole-array steps.

A text column arrives as one Arrow array. Its UTF-8 bytes are worked on as a
numpy array, a few megabytes of whole texts at a time: words are runs between
separator bytes, and a word's hash comes from prefix sums of a polynomial.
Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  # texts are worked on in runs of about this many bytes; one text is never cut

_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]  # odd, so that they have an inverse
_WINDOW = 0xD6E8FEB86659FD93

#: Separators of ``[^\x20\x09-\x0D]+`` words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words; the text is lower-cased first.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of some texts: ``data[starts[i]:ends[i]]`` is word ``i``, and those of text ``d`` are
    ``first[d]`` to ``first[d + 1]``. ``rows`` is the slice of the batch the texts come from."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs_of_texts(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def split(column: pa.Array, separators: np.ndarray, lower: bool = False) -> Iterator[Words]:
    """Words of a text column, run by run."""
    data, bounds = text_bytes(column)
    for a, b in runs_of_texts(bounds):
        part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        yield _split(slice(a, b), LOWER[part] if lower else part, own, separators)


def _split(rows: slice, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Words:
    # a word begins after a separator or where a text begins, and ends likewise
    inside = ~separators[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = np.diff(bounds) > 0
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(rows, data, bounds, starts, ends, np.searchsorted(starts, bounds))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base modulo 2**64."""
    if n > len(_POWERS.get(base, "")):
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        steps = np.multiply.accumulate(steps)
        if n > CHUNK_BYTES + 1:  # of one very long text: not kept
            return steps
        _POWERS[base] = steps
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; ``which`` chooses one of two independent ones."""
    n, base = len(words.data), _BASES[which]
    power, inverse = _powers(base, n + 1), _powers(pow(base, -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    raw = (sums[words.ends] - sums[words.starts]) * inverse[words.starts]
    return mixed(raw + (words.ends - words.starts).astype(np.uint64) * np.uint64(_WINDOW))


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` word hashes, across texts too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.full(n, seed, np.uint64), 1
    for k in range(size):
        factor = factor * (_WINDOW + 2 * seed) % (1 << 64)
        out += hashes[k : k + n] * np.uint64(factor)
    return mixed(out)


def whole_windows(first: np.ndarray, size: int, at_least: int | None = None) -> np.ndarray:
    """Positions where a window of ``size`` words lies in one text of ``at_least`` words."""
    counts = np.diff(first)
    n = np.where(counts >= (at_least or size), np.maximum(counts - size + 1, 0), 0)
    return ranges(first[:-1], n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the runs ``starts[i] .. starts[i] + lengths[i] - 1``, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` positions lie in a run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
