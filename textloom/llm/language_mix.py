"""Languages of a document as a mixture, by expectation-maximisation.

Every language is a distribution over byte trigrams centred on a letter,
learnt from labelled texts. A document's trigrams are explained as drawn from a
mixture of languages; EM finds the proportions. Languages enter one at a time,
the one with the steepest likelihood first, and stay if the log-likelihood gains
more than a penalty per language. The likelihood is concave in the proportions,
so ``N * ln(slope)`` bounds what a language can gain: most documents settle on
one language without any EM.
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

BUCKETS = 1 << 16  # trigrams are hashed into so many
SMOOTHING = 0.5
OVERLAP = 3.0  # a letter is in three trigrams; their evidence counts a third
MAX_LANGUAGES = 1000  # size check of the model sent to the tasks: 4 * BUCKETS bytes each
STEPS, TOLERANCE = 200, 1e-3
UNKNOWN = "und"

_SPACE = 0x20
_LETTERS = texts.LOWER.copy()
_LETTERS[[b for b in range(0x80) if not chr(b).isalpha()]] = _SPACE


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and how many come before each text's."""
    letters = _LETTERS[data]
    before, after = np.full_like(letters, _SPACE), np.full_like(letters, _SPACE)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    filled = np.diff(bounds) > 0
    before[bounds[:-1][filled]] = _SPACE
    after[bounds[1:][filled] - 1] = _SPACE
    at = np.flatnonzero(letters != _SPACE)
    code = before[at].astype(np.uint64) | letters[at].astype(np.uint64) << np.uint64(8) | after[at].astype(np.uint64) << np.uint64(16)
    return (texts.mixed(code + np.uint64(1)) >> np.uint64(48)).astype(np.int64), np.searchsorted(at, bounds)


@dataclass
class Model:
    """Trigram probabilities of each language: ``probability[bucket, language]``."""

    languages: list[str]
    probability: np.ndarray
    logarithm: np.ndarray


def fit(labelled: DataFrame) -> Model:
    """Learn from all rows of ``labelled(text, lang)``; a null in either is no example.

    Counting runs in the tasks, combined before the shuffle. The driver gets one
    count per language and bucket in use, checked by ``MAX_LANGUAGES``.
    """

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for rows in source:
            data, bounds = texts.text_bytes(rows.column("text"))
            names = rows.column("lang").to_pylist()
            for a, b in texts.runs_of_texts(bounds):
                own = bounds[a : b + 1] - bounds[a]
                keys, first = _trigrams(data[bounds[a] : bounds[b]], own)
                known = sorted(set(names[a:b]))
                number = np.array([known.index(x) for x in names[a:b]])
                both = np.bincount(np.repeat(number, np.diff(first)) * BUCKETS + keys, minlength=len(known) * BUCKETS)
                for name, c in zip(known, both.reshape(-1, BUCKETS), strict=True):
                    counts[name] = counts.get(name, 0) + c
        for name, c in sorted(counts.items()):
            used = np.flatnonzero(c)
            arrays = [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(c[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    counted = rows.mapInArrow(work, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).persist()
    try:
        n_languages = counted.select("lang").distinct().count()
        if n_languages > MAX_LANGUAGES:
            raise ValueError(f"{n_languages} labels; the model is checked to hold {MAX_LANGUAGES}")
        table = counted.toArrow()
    finally:
        counted.unpersist()
    languages = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(languages)))
    number = {name: i for i, name in enumerate(languages)}
    which = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    counts[table["bucket"].to_numpy(), which] = table["n"].to_numpy()
    probability = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)
    return Model(languages, probability.astype(np.float32), np.log(probability).astype(np.float32))


def _proportions(p: np.ndarray, weight: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """EM over the columns of ``p`` from ``share`` on; proportions and log-likelihood."""
    n, before = weight.sum(), -np.inf
    for _ in range(STEPS):
        mixed = p @ share
        now = float(weight @ np.log(mixed))
        if now - before < TOLERANCE:
            break
        before = now
        share = share * ((weight / mixed) @ p) / n
    return share, now


def mixture(model: Model, keys: np.ndarray) -> tuple[dict[str, float], float]:
    """Proportions of the selected languages, and how sure the main one is (0 to 1)."""
    if len(keys) > BUCKETS // 4:
        keys, weight = np.unique(keys, return_counts=True)
        weight = weight / OVERLAP
    else:
        weight = np.full(len(keys), 1 / OVERLAP)
    p, n = model.probability[keys].astype(np.float64), weight.sum()
    alone = weight @ model.logarithm[keys]
    chosen, share = [int(np.argmax(alone))], np.ones(1)
    likelihood, mixed = float(weight @ np.log(p[:, chosen[0]])), p[:, chosen[0]]
    penalty = np.log(n * OVERLAP + 1)
    growing = True
    while growing:
        growing = False
        slope = (weight / mixed) @ p / n
        slope[chosen] = 0
        for new in np.argsort(-slope, kind="stable").tolist():
            if slope[new] <= 0 or n * np.log(slope[new]) <= penalty:
                break
            more, gained = _proportions(p[:, [*chosen, new]], weight, np.append(share * 0.9, 0.1))
            if gained - likelihood > penalty:
                chosen, share, likelihood, growing = [*chosen, new], more, gained, True
                mixed = p[:, chosen] @ share
                break
    found = {model.languages[i]: float(s) for i, s in zip(chosen, share, strict=True)}
    if len(chosen) > 1:
        return found, max(found.values())
    return found, float(1 / np.exp(alone - alone.max()).sum())


_LANGUAGE = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("languages", T.MapType(T.StringType(), T.DoubleType())),
])


def identify(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: ``lang_pred, score, languages``.

    ``languages`` maps the selected languages to their proportions and
    ``lang_pred`` is the largest one's, the first by name of equals. ``score``
    is that proportion, or with a single language its share of the posterior
    over all. Only ``text`` is looked at, the whole of it. A null text, a text
    without any letter, and a model without languages give ``und``, 0 and no
    languages. Other columns of ``docs`` are kept, save one called ``name``,
    which is replaced. Empty in, empty out.
    """
    kept = [c for c in docs.columns if c != name]
    inside = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    text = f"c{kept.index('text')}"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for rows in source:
            column = rows.column(text)
            data, bounds = texts.text_bytes(column)
            found, score = [], []
            for a, b in texts.runs_of_texts(bounds):
                part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                keys, first = _trigrams(part, own)
                plain = np.concatenate(([0], np.cumsum((_LETTERS[part] != _SPACE) & (part < 0x80))))[own]
                for d in range(b - a):
                    few = keys[first[d] : first[d + 1]]
                    lettered = plain[d + 1] > plain[d] or len(few) and any(c.isalpha() for c in column[a + d].as_py())
                    shares, sure = mixture(model, few) if lettered and model.languages else ({}, 0.0)
                    found.append(shares)
                    score.append(sure)
            best = [min(s, key=lambda k: (-s[k], k)) if s else UNKNOWN for s in found]
            shares = pa.array([list(s.items()) for s in found], pa.map_(pa.string(), pa.float64()))
            language = pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), shares], _LANGUAGE.names)
            yield pa.RecordBatch.from_arrays([*rows.columns, language], names=[*rows.schema.names, "_language"])

    out = inside.mapInArrow(work, T.StructType([*inside.schema, T.StructField("_language", _LANGUAGE)]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("_language").alias(name))


def held_out(key: str = "doc_id"):
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 3, is 1. Null: false."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    """``text, lang`` of the rows to learn from; a row without id is not one."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")
