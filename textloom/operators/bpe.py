"""Byte-pair vocabulary training as rounds of Spark jobs.

The corpus is read once, to count distinct words. After that the state is the
word table in chunks ``(x, n)`` of many words a row: ``x`` holds the codes of their
symbols, each word ended by ``_GAP``, and ``n`` their counts. A task merges a pair
in a whole chunk at once and finds the pairs next to a merge by position, so a
round reads the codes and touches no text. The chunks are written anew after
``_REPLAYED`` merges; a round until then repeats the merges since.

Pairs are counted over all words once. The most frequent ones (``FRONTIER``) are
the driver's frontier, and every other pair is known to be no more frequent than
the last of them. A round merges a batch in the word table and returns only what
changed: the counts of the pairs next to the merged ones, summed over the words
that hold them. Counts of old pairs never grow and those of new pairs are fully
in that difference, so the frontier stays exact until its best pair is no better
than the pairs it does not know; then all words are counted again.

A batch gives the same merges, in the same order, as one merge at a time. Pairs
are ranked by (count descending, left, right), and the batch is a prefix of that
ranking. Merging (a, b) changes only pairs that touch it, (x, a) and (b, y), which
can but fall, and makes (x, ab) and (ab, y), which are at most as frequent as
those. The batch goes on while the next pair ranks before all of them. A pair of
equal symbols, and one whose product is a symbol already, goes alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.words import SPECIALS, WORD_PATTERN, word_counts
from textloom.plans.shared_dir import materialise

WORD_END = "</w>"
_OPEN, _CLOSE = "\x01", "\x02"  # around each symbol of a word
FRONTIER = 200_000  # pairs the driver keeps
_WORDS_PER_TASK = 200_000
_WORDS_PER_CHUNK = 1 << 16
_REPLAYED = 16  # merges that each round repeats before the chunks are written anew
_GAP, _FIRST = -1, 1 << 22  # the code after a word, and of the first product; those of characters are smaller

_MERGES = "rank int, left string, right string, merged string, n bigint"


def _boxed(symbol: str) -> str:
    return f"{_OPEN}{symbol}{_CLOSE}"


def symbol_text(word: Column, word_end: str = WORD_END) -> Column:
    """A word as boxed characters, the last one carrying the word-end mark."""
    boxed = F.regexp_replace(word, "(?s)(.)", f"{_OPEN}$1{_CLOSE}")
    return F.concat(F.substr(boxed, F.lit(1), F.length(boxed) - 1), F.lit(word_end + _CLOSE))


def symbols(s: Column) -> Column:
    """The symbols of a boxed word."""
    return F.split(F.substr(s, F.lit(2), F.length(s) - 2), _CLOSE + _OPEN, -1)


def symbol_words(counts: DataFrame, word_end: str = WORD_END) -> DataFrame:
    """``(word, n, s)`` from word counts."""
    return counts.select("word", "n", symbol_text(F.col("word"), word_end).alias("s"))


def pair_counts(words: DataFrame) -> DataFrame:
    """``(left, right, n)``: weighted counts of adjacent symbols."""
    parts = words.select("n", symbols(F.col("s")).alias("a")).where(F.size("a") > 1)
    lefts, rights = F.slice("a", F.lit(1), F.size("a") - 1), F.slice("a", F.lit(2), F.size("a") - 1)
    pairs = parts.select("n", F.explode(F.arrays_zip(lefts.alias("left"), rights.alias("right"))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


class Frontier:
    """The most frequent pairs and their exact counts, with the rule of batches."""

    def __init__(self, ranked: list[tuple[str, str, int]], last: tuple):
        """``ranked`` holds every pair that ranks up to ``last``, as (-count, left, right)."""
        self.last = last
        self.count: dict[tuple[str, str], int] = {}
        self.heap: list[tuple[int, str, str]] = []
        self.with_left: dict[str, set[str]] = {}
        self.with_right: dict[str, set[str]] = {}
        self.stale = False
        for left, right, n in ranked:
            self._set(left, right, n)

    def _set(self, left: str, right: str, n: int) -> None:
        if n <= 0:
            self.count.pop((left, right), None)
            self.with_left.get(left, set()).discard(right)
            self.with_right.get(right, set()).discard(left)
            return
        self.count[left, right] = n
        self.with_left.setdefault(left, set()).add(right)
        self.with_right.setdefault(right, set()).add(left)
        heapq.heappush(self.heap, (-n, left, right))

    def _best(self) -> tuple[int, str, str] | None:
        while self.heap and self.count.get(self.heap[0][1:]) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return None if self.stale or not self.heap or self.heap[0] > self.last else self.heap[0]

    def _barrier(self, left: str, right: str) -> tuple[int, str, str]:
        """No pair that merging this one changes or makes can rank before this."""
        n, product = self.count[left, right], left + right
        first = (1, "", "")
        for x in self.with_right.get(left, ()):
            m = self.count[x, left]
            first = min(first, (-m, x, left), (-min(m, n), x, product))
        for y in self.with_left.get(right, ()):
            m = self.count[right, y]
            first = min(first, (-m, right, y), (-min(m, n), product, y))
        return first

    def batch(self, made: set[str], most: int | None) -> list[tuple[str, str, int]]:
        """The next merges; none if the frontier has to be counted anew."""
        found: list[tuple[str, str, int]] = []
        barrier = (1, "", "")
        products: set[str] = set()
        while (best := self._best()) is not None and best < barrier and (most is None or len(found) < most):
            n, left, right = best
            alone = left == right or left + right in made
            if found and (alone or left + right in products):
                break
            heapq.heappop(self.heap)
            found.append((left, right, -n))
            if alone:
                break
            products.add(left + right)
            barrier = min(barrier, self._barrier(left, right), (self.last[0], "", ""))  # pairs not known may touch it too
        for left, right, n in found:  # until the difference takes it away
            heapq.heappush(self.heap, (-n, left, right))
        return found

    def apply(self, difference: list[tuple[str, str, int]], products: set[str]) -> None:
        """Change counts by what a round has changed; ``products`` are the symbols it has made first."""
        for left, right, change in difference:
            old = self.count.get((left, right))
            if old is not None:
                self._set(left, right, old + change)
            elif left in products or right in products:
                self._set(left, right, change)
            elif change > 0:  # a pair that is not known has grown
                self.stale = True


class Symbols:
    """Codes of symbols: twice the character, one more at the end of a word; products are numbered."""

    def __init__(self, word_end: str):
        self.word_end, self.products, self.codes = word_end, [], {}

    def code(self, symbol: str) -> int:
        if len(symbol) == 1:
            return 2 * ord(symbol)
        if len(symbol) == 1 + len(self.word_end) and symbol.endswith(self.word_end):
            return 2 * ord(symbol[0]) + 1
        if symbol not in self.codes:
            self.codes[symbol] = _FIRST + len(self.products)
            self.products.append(symbol)
        return self.codes[symbol]

    def name(self, code: int) -> str:
        if code >= _FIRST:
            return self.products[code - _FIRST]
        return chr(code >> 1) + (self.word_end if code & 1 else "")

    def rules(self, batch: list[tuple[str, str, int]]) -> list[tuple[int, int, int]]:
        return [(self.code(a), self.code(b), self.code(a + b)) for a, b, _ in batch]


def _coded(words: list[str], marked: bool) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # where the gaps are
    x = np.full(len(words) + int(sizes.sum()), _GAP, np.int32)
    inside = np.ones(len(x), bool)
    inside[ends] = False
    x[inside] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32) * 2
    x[ends[sizes > 0] - 1] += marked
    return x


def _chunks(counts: DataFrame, marked: bool) -> DataFrame:
    """``(x, n)``: the words of each task in chunks."""

    def chunk(words: list[str], n: list[int]) -> pa.RecordBatch:
        return _batch(_coded(words, marked), np.array(n, np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            n += batch.column("n").to_pylist()
            if len(words) >= _WORDS_PER_CHUNK:
                yield chunk(words, n)
                words, n = [], []
        if words:
            yield chunk(words, n)

    return counts.select("word", "n").mapInArrow(work, "x binary, n binary")


def _batch(x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"x": pa.array([x.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})


def _each(batches: Iterator[pa.RecordBatch], rules: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chunks after the merges of ``rules``, in order."""
    for batch in batches:
        for x, n in zip(batch.column("x").to_pylist(), batch.column("n").to_pylist(), strict=True):
            yield _merged(np.frombuffer(x, np.int32), rules)[0], np.frombuffer(n, np.int64)


def _hits(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where the pair is merged, from left to right."""
    at = np.flatnonzero(x[:-1] == a)
    at = at[x[at + 1] == b]
    if a == b and len(at):  # of a run of equal symbols every second one
        i = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, i, 0))
        at = at[(i - run) % 2 == 0]
    return at


def _merged(x: np.ndarray, rules: list[tuple[int, int, int]], start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Merges in order; ``start`` goes along with the symbols that stay."""
    x = x.copy()
    for a, b, product in rules:
        at = _hits(x, a, b)
        if len(at):
            x[at] = product
            stay = np.ones(len(x), bool)
            stay[at + 1] = False
            x, start = x[stay], None if start is None else start[stay]
    return x, start


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``left, right, n`` from (pair, n), each pair once."""
    keys, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    n = np.add.reduceat(n, first) if len(first) else n
    keys, n = keys[first][n != 0], n[n != 0]
    return keys >> 32, keys & 0xFFFFFFFF, n


def _pairs(x: np.ndarray, n: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside words and their counts ``n`` by symbol; only those that touch a symbol of ``near``, if given."""
    at = (x[:-1] >= 0) & (x[1:] >= 0)
    at = np.flatnonzero(at if near is None else at & (near[:-1] | near[1:]))
    return x[at].astype(np.int64) << 32 | x[at + 1], n[at]


def _by_symbol(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(n, np.diff(np.flatnonzero(x == _GAP), prepend=-1))


def _all_pairs(chunks: DataFrame, rules: list[tuple[int, int, int]], symbols: Symbols) -> DataFrame:
    """``(left, right, n)`` over all words, after the merges of ``rules``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, n in _each(batches, rules):
            left, right, total = _summed([_pairs(x, _by_symbol(x, n))])
            named = [pa.array([symbols.name(c) for c in side.tolist()], pa.string()) for side in (left, right)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(total)], names=["left", "right", "n"])

    return chunks.mapInArrow(work, "left string, right string, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _changed_pairs(chunks: DataFrame, before: list[tuple[int, int, int]], rules: list[tuple[int, int, int]]) -> DataFrame:
    """``(left, right, n)``: how the merges of ``rules`` change counts, where they do, by codes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for old, n in _each(batches, before):
            new, start = _merged(old, rules, np.arange(len(old)))
            size = np.diff(start, append=len(old))
            touched = size > 1
            if not touched.any():
                continue
            n = _by_symbol(old, n)
            left, right, total = _summed([_pairs(old, -n, np.repeat(touched, size)), _pairs(new, n[start], touched)])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (left, right, total)], names=["left", "right", "n"])

    changes = chunks.mapInArrow(work, "left bigint, right bigint, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return changes.where("n <> 0")


def _rewritten(chunks: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    return materialise(chunks.mapInArrow(lambda batches: (_batch(x, n) for x, n in _each(batches, rules)), "x binary, n binary"), "words")


def _alphabet(chunks: DataFrame, symbols: Symbols) -> DataFrame:
    """The characters of all words as symbols."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _each(batches, []):
            yield pa.RecordBatch.from_pydict({"token": pa.array([symbols.name(c) for c in np.unique(x[x >= 0]).tolist()], pa.string())})

    return materialise(chunks.mapInArrow(work, "token string").distinct(), "alphabet")


def _word_table(chunks: DataFrame, rules: list[tuple[int, int, int]], symbols: Symbols) -> DataFrame:
    """``(word, n, s)`` after the merges of ``rules``, with boxed symbols."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, n in _each(batches, rules):
            names = {c: symbols.name(c) for c in np.unique(x[x >= 0]).tolist()}
            parts = [[names[c] for c in w[:-1].tolist()] for w in np.split(x, np.flatnonzero(x == _GAP) + 1)[:-1]]
            words = ["".join(p).removesuffix(symbols.word_end) for p in parts]
            boxed = ["".join(map(_boxed, p)) for p in parts]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(n), "s": pa.array(boxed, pa.string())})

    return chunks.mapInArrow(work, "word string, n bigint, s string")


def train(
    counts: DataFrame,
    vocab_size: int | None = 50_000,
    min_frequency: int = 10,
    max_merges: int | None = None,
    specials: tuple[str, ...] = SPECIALS,
    word_end: str = WORD_END,
    frontier: int = FRONTIER,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Learn merges from ``(word, n)``; returns ``(vocab, merges, words)``.

    Stops when the vocabulary has ``vocab_size`` tokens, after ``max_merges``
    merges, or when no pair occurs ``min_frequency`` times. ``words`` is the
    word table after all merges. The driver holds ``frontier`` pairs and the
    merges; a round's difference has at most a few pairs per symbol and merge.
    """
    spark = counts.sparkSession
    counted = materialise(counts, "word-counts")
    # few bytes but much work per row: keep all cores busy
    parts = max(counted.count() // _WORDS_PER_TASK, spark.sparkContext.defaultParallelism)
    names = Symbols(word_end)
    chunks = materialise(_chunks(counted.repartition(parts, "word"), bool(word_end)), "words")
    alphabet = _alphabet(chunks, names)
    room = None if vocab_size is None else vocab_size - len(specials) - alphabet.count()
    wanted = min((x for x in (room, max_merges) if x is not None), default=None)

    learnt: list[tuple[str, str, int]] = []
    made: set[str] = set()
    known, complete = None, False
    since: list[tuple[int, int, int]] = []  # merges that the chunks do not have
    while wanted is None or len(learnt) < wanted:
        batch = known.batch(made, None if wanted is None else wanted - len(learnt)) if known else []
        if not batch:
            if known and not known.stale and complete:
                break
            frequent = _all_pairs(chunks, since, names).where(F.col("n") >= min_frequency)
            top = [tuple(r) for r in frequent.orderBy(F.desc("n"), "left", "right").limit(frontier).collect()]
            complete = len(top) < frontier
            known = Frontier(top, (0.5 - min_frequency,) if complete else (-top[-1][2], *top[-1][:2]))
            if not top:
                break
            continue
        learnt += batch
        products = {a + b for a, b, _ in batch} - made
        made |= products

        rules = names.rules(batch)
        changes = _changed_pairs(chunks, since, rules).collect()
        known.apply([(names.name(r["left"]), names.name(r["right"]), r["n"]) for r in changes], products)
        since = since + rules
        if len(since) >= _REPLAYED:
            chunks, since = _rewritten(chunks, since), []

    merges = spark.createDataFrame([(i, a, b, a + b, n) for i, (a, b, n) in enumerate(learnt)], _MERGES)
    return vocabulary(alphabet, merges, specials), merges, _word_table(chunks, since, names)


def vocabulary(alphabet: DataFrame, merges: DataFrame, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """``(token, id, is_special)``: specials, alphabet by name, products by rank.

    Every input is bounded by the vocabulary size, so the one row that numbers
    the tokens is too. A product made by two merges keeps its first id.
    """
    spark = alphabet.sparkSession
    letters = alphabet.select(F.lit(0).alias("part"), F.lit(0).alias("rank"), "token")
    products = merges.groupBy(F.col("merged").alias("token")).agg(F.min("rank").alias("rank"))
    products = products.select(F.lit(1).alias("part"), "rank", "token").join(alphabet, "token", "left_anti")
    tokens = letters.unionByName(products)
    ranked = tokens.agg(F.array_sort(F.collect_list(F.struct("part", "rank", "token"))).alias("a"))
    learnt = ranked.select(F.posexplode("a").alias("i", "t")).select(
        F.col("t.token").alias("token"), (F.col("i") + len(specials)).cast("int").alias("id"), F.lit(False).alias("is_special")
    )
    head = spark.createDataFrame([(t, i, True) for i, t in enumerate(specials)], "token string, id int, is_special boolean")
    return head.unionByName(learnt)


def train_on_text(df: DataFrame, text: str = "text", pattern: str = WORD_PATTERN, **options):
    """``train`` on the words of any text table, batch files or cleaned rows alike."""
    return train(word_counts(df, text, pattern), **options)
