"""Quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import divergence as dv


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base(text):
    w, text = words_of(text), text or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(w) < 10 or 100 * len(hit) > 20 * len(w),
    )


def classes(text):
    upper, digit = sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text)
    symbol = sum(c in "#*$%&|<>" for c in text)
    mark = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text) - symbol
    space = sum(c in " \t\n\x0b\x0c\r" for c in text)
    return [upper, digit, symbol, mark, len(text.encode()) - len(text), space, len(text) - upper - digit - symbol - mark - space]


def jensen_shannon(p, q):
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))


def learnt(rows):
    out = {}
    for lang in {r[2] for r in rows if r[2] is not None and r[1] is not None}:
        texts = [r[1] for r in rows if r[2] == lang and r[1] is not None]
        n, c = Counter(w.lower() for t in texts for w in words_of(t)), [sum(x) for x in zip(*map(classes, texts), strict=True)]
        if n:
            top = sorted(n.items(), key=lambda x: (-x[1], x[0]))[: dv.COMMON]
            out[lang] = ([x / sum(c) for x in c], [(w, k / n.total()) for w, k in top])
    return out


PROSE = "The cat, the dog and the bird of the house went to the river in the morning and sat by the tree. "
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", "en"), (4, "one two", None), (5, PROSE * 30, "en"), (6, "a b c d e " * 4, "xx"), (None, None, None),
    (7, "\n".join(f"line {i % 3}" for i in range(50)), "en"), (8, "# * $ % & | < > é\U0001f600\n\n x \n x \n", "fr"), (9, "é à " * 50, "fr"), (9, "é à " * 50, "fr"),
    (10, "\x0b".join(f"u{i}" for i in range(300)), "en"), (11, "| a$ | b# |" * 60, "en"), (12, "a b c d e f a b c d e g", "en"), (13, "a a a a a a", "en"),
    (14, " ".join(f"v{i}" for i in range(20_000)) + " end v0 v1 v2 v3 v4 v5", "en"), (15, PROSE, "unseen"), (16, "x" * 100_000, "en"),
]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id bigint, text string, lang string, n_words int, quality string")
    refs = dv.learn(docs)
    want = learnt(rows)
    for lang, (shares, common) in want.items():
        assert refs.classes[lang] == pytest.approx(shares)
        assert [w for w, _ in refs.words[lang]] == [w for w, _ in common]
        assert [s for _, s in refs.words[lang]] == pytest.approx([s for _, s in common])
    out = dv.judge(docs, refs)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "quality"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        q, b = r.quality, base(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == b
        key = r.lang if r.lang in refs.classes else None
        if b[0] < dv.JUDGED_WORDS:
            assert q.class_distance is None and q.word_distance is None
        else:
            c = classes(r.text)
            assert q.class_distance == pytest.approx(jensen_shannon([x / sum(c) for x in c], refs.classes[key]), abs=1e-6)
        common = refs.words[key]
        if b[0] >= dv.JUDGED_WORDS and sum(s for _, s in common) * b[0] >= dv.JUDGED_COMMON:
            n = Counter(w.lower() for w in words_of(r.text))
            p, s = [n[w] / b[0] for w, _ in common], [s for _, s in common]
            assert q.word_distance == pytest.approx(jensen_shannon([*p, max(0, 1 - sum(p))], [*s, max(0, 1 - sum(s))]), abs=1e-6)
        else:
            assert q.word_distance is None
        far = (q.class_distance or 0) > dv.CLASS_DISTANCE or (q.word_distance or 0) > dv.WORD_DISTANCE
        assert q.kept == (not b[5] and not far)
    return {r.doc_id: r.quality for r in got}


def test_odd_rows(spark):
    found = check(spark, ROWS)
    assert not found[5].kept and found[15].kept  # a text that repeats itself; a short clean one


def test_random_texts(spark):
    rng = random.Random(4)
    rows = []
    for d in range(150):
        n, v = rng.randrange(0, 200), rng.choice([2, 5, 400])
        rows.append((d, "".join(f"w{rng.randrange(v)}" + rng.choice([" ", " ", "\n", "  ", ". ", "\t"]) for _ in range(n)), rng.choice(["a", "b", None])))
    check(spark, rows)


def test_clean_prose_is_kept_and_symbol_lists_are_not(spark):
    rng = random.Random(1)
    vocabulary = "the of and to a in is it that was for on are with as his they be at one have this from or had by word but not what all were we when".split()
    prose = lambda: " ".join(rng.choice(vocabulary + [f"w{rng.randrange(900)}" for _ in range(20)]) for _ in range(300)).capitalize() + "."
    rows = [(i, prose(), "en") for i in range(60)]
    junk = " ".join(f"x{i}$$$ |" for i in range(300))
    found = check(spark, [*rows, (100, junk, "en"), (101, junk, None)])
    assert all(found[i].kept for i in range(60)) and not found[100].kept and not found[101].kept


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    refs = dv.learn(docs)
    assert dv.judge(docs, refs).count() == 0
    one = spark.createDataFrame([(1, PROSE, None)], "doc_id bigint, text string, lang string")
    assert dv.judge(one, refs).select("quality.kept").first()[0]
    assert dv.judge(one.drop("lang"), refs).where(F.col("quality.n_words") > 0).count() == 1


def test_texts_without_common_words_are_not_kept(spark):
    rng = random.Random(6)
    usual = "the of and to a in is it that was for on are with as his they be at one".split()
    prose = lambda n: " ".join(rng.choice(usual) if rng.random() < 0.27 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    other = lambda n: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))
    rows = [(i, prose(300), "en") for i in range(60)] + [(70 + i, prose(200), lang) for i, lang in enumerate(("en", None))]
    rows += [(80, other(200), "en"), (81, other(200), None), (82, other(5_000), "en"), (83, other(40), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    refs = dv.learn(docs)
    found = {r.doc_id: r.quality for r in dv.judge(docs, refs).collect()}
    assert all(found[i].kept for i in [*range(60), 70, 71]) and found[83].kept  # the last is too short to judge
    assert not any(found[i].kept for i in (80, 81, 82))
    assert all(found[i].class_distance <= dv.CLASS_DISTANCE and found[i].word_distance <= dv.WORD_DISTANCE for i in (80, 81, 82))
    assert found[80].word_distance == pytest.approx(dv.without_common([s for _, s in refs.words["en"]]), abs=1e-3)


def test_pooled_words_count_in_every_language(spark):
    # "shared" ranks behind 32 words of its own in either language, but first in both together
    own = lambda lang: " ".join(f"{lang}{i} " * 6 for i in range(dv.COMMON)) + "shared " * 5
    docs = spark.createDataFrame([(own("a"), "a"), (own("b") + " Shared", "b")], "text string, lang string")
    refs = dv.learn(docs)
    counts = Counter(w.lower() for t in (own("a"), own("b") + " Shared") for w in words_of(t))
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: dv.COMMON]
    assert want[0] == ("shared", 11) and "shared" not in dict(refs.words["a"])
    assert [w for w, _ in refs.words[None]] == [w for w, _ in want]
    assert [s for _, s in refs.words[None]] == pytest.approx([n / counts.total() for _, n in want])
