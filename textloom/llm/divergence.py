"""Quality by distribution divergence, in DataFrame expressions only.

A document's character classes and its use of common words are two histograms.
Each is compared with the reference of the document's language by the
Jensen-Shannon distance; prose is near its reference, and lists of symbols,
codes or a repeated word are far from it. Short documents have ragged histograms
and are not judged.

How far a text without any common word is depends on the share those words have
in the reference (0.39 for 27 %), so the word distance is also held against that
distance: from ``NO_COMMON`` of it on a text is far. A text of no known language
shares few words with all languages together even if it is prose; it is far in
this sense if it has next to no word that is common in any language.

References come from all labelled documents; a document without a known
language is compared with the reference of all labelled documents together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.shared_dir import materialise

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed values of the base rules
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # base rules: fewer words, or more than this per cent in repeated windows

COMMON = 32  # words per language in the word histogram
MAX_LANGUAGES = 1000  # size check of the references, which are part of the plan
JUDGED_WORDS = 50  # shorter documents pass
JUDGED_COMMON = 15  # common words expected at least, or the word histogram is not judged
CLASS_DISTANCE = 0.3
WORD_DISTANCE = 0.53
NO_COMMON = 0.95  # of the distance of a text without common words


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more.

    ``hashes`` has one 64-bit hash per word. Windows are hashed and sorted, so
    the work grows with the text and not with its repetitions.
    """
    last = F.size(hashes) - size
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))

    def covered(rows: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(rows, i)["h"] == F.get(rows, j)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), last), lambda i: same(i, i - 1) | same(i, i + 1))
        at = F.sort_array(F.transform(at, lambda i: F.get(rows, i)["i"]))
        step = lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(size), i + size - acc["end"])).alias("n"), (i + size).alias("end")
        )
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

    def count(w: Column) -> Column:
        rows = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(rows, covered)).otherwise(F.lit(0))

    return F.when(last >= 1, let(windows, count)).otherwise(F.lit(0))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _left(text: Column, characters: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _marked(text: Column) -> Column:
    """What of a text is neither white space, a small letter nor beyond ASCII: little, so that classes are cheap to count in it."""
    return F.regexp_replace(text, r"[^!-`{-~]+", "")


def classes(text: Column, marked: Column, word_chars: Column) -> list[Column]:
    """Character counts by class: upper case, digits, symbols, marks, bytes beyond ASCII, space, and the rest."""
    symbols = _left(marked, SYMBOLS)
    parts = [
        _left(marked, "A-Z"),
        _left(marked, "0-9"),
        symbols,
        _left(marked, r"!-/:-@\[-`{-~") - symbols,
        F.octet_length(text) - F.length(text),
        F.length(text) - word_chars,
    ]
    rest = F.length(text)
    for p in parts[:4] + parts[5:]:
        rest = rest - p
    return [*parts, rest]


N_CLASSES, SPACE_CLASS = 7, 5


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (null: empty), ``_words`` and the base counts in ``_m``."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", words(F.col("_text")))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("_chars", F.length(F.array_join("_words", ""))).withColumn("_marked", _marked(F.col("_text")))
    base = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.col("_chars").cast("bigint").alias("word_chars"),
        _left(F.col("_marked"), SYMBOLS).cast("bigint").alias("n_symbols"),
        repeated_lines(F.col("_text")).cast("bigint").alias("n_dup_lines"),
        let(hashes, lambda h: repeated_words(h)).cast("bigint").alias("n_repeat_words"),
    )
    return rows.withColumn("_m", base)


@dataclass
class References:
    """Per language (None: all together) the class shares, and the common words with their shares."""

    classes: dict[str | None, list[float]]
    words: dict[str | None, list[tuple[str, float]]]


def learn(docs: DataFrame, common: int = COMMON) -> References:
    """References from every row of ``docs(text, lang)`` with a language and a word.

    Counts are combined before the shuffle. What reaches the driver is one row
    of class counts and ``common`` words per language, checked by
    ``MAX_LANGUAGES``, and the ``common`` words of all languages together.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").dropna()
    lengths = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).limit(MAX_LANGUAGES + 1).collect()
    if len(lengths) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counted = rows.select("lang", F.explode(words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counted = materialise(counted, "word-counts")
    w = F.col("w")
    parts = classes(w, _marked(w), F.length(w))  # of each different word once; white space is what the words leave
    sums = counted.groupBy("lang").agg(
        *[F.sum(p * F.col("n")).alias(f"c{i}") for i, p in enumerate(parts)], F.sum(F.length(w) * F.col("n")).alias("inside"), F.sum("n").alias("n")
    )
    found = sums.collect()
    lowered = counted.select("lang", F.lower("w").alias("w"), "n").repartition("w")  # serves both groupings below
    counted = lowered.groupBy("lang", "w").agg(F.sum("n").alias("n"))
    words_in = counted.groupBy("w").agg(F.collect_list(F.struct("lang", "n")).alias("own"), F.sum("n").alias("n"))  # an entry a language
    whole = F.array(F.struct(F.lit(None).cast("string").alias("lang"), F.col("n")))
    counted = words_in.select("w", F.explode(F.concat("own", whole)).alias("x")).select("x.lang", "w", "x.n")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = counted.withColumn("r", F.row_number().over(best)).where(F.col("r") <= common).orderBy("lang", "r").collect()

    shares, frequent, total = {}, {}, {r["lang"]: r["n"] for r in found if r["n"]}
    chars = {r["lang"]: r["chars"] for r in lengths}
    counts = {r["lang"]: [r[f"c{i}"] if i != SPACE_CLASS else chars[r["lang"]] - r["inside"] for i in range(N_CLASSES)] for r in found if r["n"]}
    for lang, c in counts.items():
        shares[lang] = [x / max(1, sum(c)) for x in c]
        frequent[lang] = [(r["w"], r["n"] / total[lang]) for r in top if r["lang"] == lang]
    if counts:
        whole = [sum(c) for c in zip(*counts.values(), strict=True)]
        shares[None] = [x / max(1, sum(whole)) for x in whole]
        frequent[None] = [(r["w"], r["n"] / sum(total.values())) for r in top if r["lang"] is None]
    return References(shares, frequent)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        own = lambda a: F.when(a > 0, a * F.log2(2 * a / (x + y))).otherwise(F.lit(0.0))
        return (own(x) + own(y)) / 2

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _jensen_shannon(p: float, q: float) -> float:
    """Jensen-Shannon distance of the shares (p, 1 - p) and (q, 1 - q)."""
    own = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, (own(p, q) + own(q, p) + own(1 - p, 1 - q) + own(1 - q, 1 - p)) / 2))


def without_common(shares: list[float]) -> float:
    """The word distance of a text that uses none of the common words with these shares."""
    return _jensen_shannon(0.0, min(1.0, sum(shares)))


def _next_to_none(share: float) -> float:
    """Common words up to this share are as good as none where ``share`` is usual."""
    low, high = 0.0, share
    for _ in range(50):
        half = (low + high) / 2
        low, high = (half, high) if _jensen_shannon(half, share) >= NO_COMMON * _jensen_shannon(0.0, share) else (low, half)
    return low


def _by_language(values: dict, kind: str) -> Column:
    """The document's language's value, or that of all languages."""
    own = [x for lang, v in values.items() if lang is not None for x in (F.lit(lang), v)]
    table = F.create_map(*own) if own else F.lit(None).cast(f"map<string,{kind}>")
    return F.coalesce(F.try_element_at(table, F.coalesce(F.col("lang").cast("string"), F.lit(""))), values[None])


def judge(docs: DataFrame, references: References, name: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``name``.

    It holds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``,
    ``base_failed``, the distances ``class_distance`` and ``word_distance``
    (null where not judged) and ``kept``: false if a base rule or a distance
    says so. Null and empty texts have no words and fail. A null or unknown
    ``lang`` is compared with all languages together. Without references
    nothing is judged beyond the base rules. Rows come out as often as they
    went in; other columns are kept, save one called ``name``, which is
    replaced. Empty in, empty out.
    """
    kept = [c for c in docs.columns if c != name]
    inside = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    lang = F.col(f"c{kept.index('lang')}") if "lang" in kept else F.lit(None).cast("string")
    rows = measured(inside.withColumn("text", F.col(f"c{kept.index('text')}")).withColumn("lang", lang))
    m = lambda c: F.col(f"_m.{c}")
    failed = (m("n_words") < LEAST_WORDS) | (100 * m("n_repeat_words") > MOST_REPEATED * m("n_words"))
    if references.classes:
        counts = F.array(*[c.cast("double") for c in classes(F.col("_text"), F.col("_marked"), F.col("_chars"))])
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        share = lambda a: let(a, lambda x: let(F.greatest(total(x), F.lit(1.0)), lambda t: F.transform(x, lambda v: v / t)))
        reference = _by_language({k: F.array(*map(F.lit, v)) for k, v in references.classes.items()}, "array<double>")
        by_class = distance(share(counts), reference)

        every = sorted({w for v in references.words.values() for w, _ in v})
        names = _by_language({k: F.array(*[F.lit(w) for w, _ in v]) for k, v in references.words.items()}, "array<string>")
        usual = _by_language({k: F.array(*[F.lit(s) for _, s in v]) for k, v in references.words.items()}, "array<double>")
        # each word's place among the common ones, 0 for others; then how often each place occurs
        placed = let(names, lambda own: F.transform("_words", lambda w: F.array_position(own, F.lower(w))))
        how_often = lambda at: F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.size(at) - F.size(F.array_remove(at, k)))
        found_at = let(placed, lambda at: F.array_remove(at, 0))
        seen = let(found_at, lambda at: F.transform(how_often(at), lambda c: c / m("n_words")))
        rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(1.0) - total(a), F.lit(0.0))))
        by_word = distance(let(seen, rest), let(usual, rest))
        expected = total(usual) * m("n_words")
        long = m("n_words") >= JUDGED_WORDS
        rows = rows.withColumn("_class", F.when(long, by_class)).withColumn("_word", F.when(long & (expected >= JUDGED_COMMON), by_word))
        bounds = {k: F.lit(NO_COMMON * without_common([x for _, x in v])) for k, v in references.words.items()}
        bounds[None] = F.lit(None).cast("double")  # prose of one language is as far from all of them together
        least = min(sum(x for _, x in v) for k, v in references.words.items() if k is not None)
        bound = _by_language(bounds, "double")
        used = F.filter("_words", lambda w: F.lower(w).isin(every))
        foreign = long & (least * m("n_words") >= JUDGED_COMMON) & (F.size(used) <= _next_to_none(least) * m("n_words"))
        rows = rows.withColumn("_few", F.when(bound.isNotNull(), F.col("_word") >= bound).otherwise(foreign))
    else:
        rows = rows.withColumn("_class", F.lit(None).cast("double")).withColumn("_word", F.lit(None).cast("double"))
        rows = rows.withColumn("_few", F.lit(False))
    far = F.coalesce(F.col("_class") > CLASS_DISTANCE, F.lit(False)) | F.coalesce((F.col("_word") > WORD_DISTANCE) | F.col("_few"), F.lit(False))
    found = F.struct(
        *[m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        F.col("_class").alias("class_distance"),
        F.col("_word").alias("word_distance"),
        (~failed & ~far).alias("kept"),
    )
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], found.alias(name))
