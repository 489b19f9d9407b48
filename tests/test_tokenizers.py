"""Vocabulary training, encoding and decoding."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import bpe, words
from textloom.operators import encode as enc
from textloom.sinks.writers import load_tokenizer, save_tokenizer


def plain_merges(counts, n_merges, min_frequency=1):
    """One merge at a time, on lists."""
    state = {w: [*w[:-1], w[-1] + "</w>"] for w in counts}
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for w, syms in state.items():
            for pair in zip(syms, syms[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        (left, right), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < min_frequency:
            break
        merges.append((left, right, n))
        for w, syms in state.items():
            text = "".join(f"<{s}>" for s in syms).replace(f"<{left}><{right}>", f"<{left + right}>")
            state[w] = text[1:-1].split("><")
    return merges, state


@pytest.fixture(scope="module")
def toy(spark):
    rnd = random.Random(11)
    stems = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    counts = Counter(rnd.choice(stems) for _ in range(3000))
    counts.update({"aaaa": 40, "aaaaa": 13, "abab": 77})
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return dict(counts), df


def test_exact_rounds_equal_single_merges(toy):
    counts, df = toy
    vocab, merges, table = bpe.train(df, vocab_size=None, max_merges=70, min_frequency=5)
    want, state = plain_merges(counts, 70, 5)
    got = [(r.left, r.right, r.n) for r in merges.orderBy("rank").collect()]
    assert got == want
    assert {r.word: r.a for r in table.select("word", bpe.symbols(F.col("s")).alias("a")).collect()} == state
    ids = {r.token: r.id for r in vocab.collect()}
    assert ids["<|endoftext|>"] == 0 and ids["<|unk|>"] == 1
    assert sorted(ids.values()) == list(range(len(ids)))


def test_rounds_handle_chunks_of_words(toy, monkeypatch):
    """What training writes between rounds has a row for many words, not one for each."""
    counts, df = toy
    rows = []

    def counted(table, name, write=bpe.materialise):
        out = write(table, name)
        rows.extend([out.count()] * (name == "words"))
        return out

    monkeypatch.setattr(bpe, "materialise", counted)
    _, merges, _ = bpe.train(df.coalesce(1), vocab_size=None, max_merges=70, min_frequency=5)
    assert merges.count() == 70 and rows and max(rows) <= 8 < len(counts) / 4


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=9), min_size=1, max_size=12), st.data())
@settings(max_examples=100, deadline=None)
def test_changes_of_a_chunk(texts, data):
    """Merges in a chunk and the change of its pairs, against lists."""
    names, n = bpe.Symbols("</w>"), np.arange(1, len(texts) + 1)
    old = bpe._coded(texts, True)
    state = [[*w[:-1], w[-1] + "</w>"] for w in texts]
    before = pairs_of(dict(enumerate(state)), dict(enumerate(n)))
    batch = data.draw(st.lists(st.sampled_from([("a", "b", 0), ("a", "a", 0), ("b", "a", 0), ("b", "b</w>", 0), ("ab", "a", 0)]), min_size=1, max_size=3))
    for left, right, _ in batch:
        state = ["".join(f"<{x}>" for x in w).replace(f"<{left}><{right}>", f"<{left + right}>")[1:-1].split("><") for w in state]
    after = pairs_of(dict(enumerate(state)), dict(enumerate(n)))
    new, start = bpe._merged(old, names.rules(batch), np.arange(len(old)))
    assert [names.name(c) if c >= 0 else None for c in new.tolist()] == [x for w in state for x in [*w, None]]
    size, weight = np.diff(start, append=len(old)), bpe._by_symbol(old, n)
    found = bpe._summed([bpe._pairs(old, -weight, np.repeat(size > 1, size)), bpe._pairs(new, weight[start], size > 1)])
    got = {(names.name(a), names.name(b)): c for a, b, c in zip(*[f.tolist() for f in found], strict=True)}
    assert got == {p: after[p] - before[p] for p in {*before, *after} if after[p] != before[p]}


def test_vocabulary_size_and_frequency_stop(toy):
    _, df = toy
    vocab, _, _ = bpe.train(df, vocab_size=20, min_frequency=1)
    assert vocab.count() == 20
    _, merges, _ = bpe.train(df, vocab_size=None, min_frequency=900)
    assert all(r.n >= 900 for r in merges.collect())


@pytest.mark.parametrize("frontier", [3, 17])
def test_frontier_that_does_not_hold_all_pairs(toy, frontier):
    counts, df = toy
    _, merges, _ = bpe.train(df, vocab_size=None, max_merges=45, min_frequency=5, frontier=frontier)
    assert [(r.left, r.right, r.n) for r in merges.orderBy("rank").collect()] == plain_merges(counts, 45, 5)[0]


def pairs_of(state, counts):
    pairs = Counter()
    for w, syms in state.items():
        for pair in zip(syms, syms[1:]):
            pairs[pair] += counts[w]
    return pairs


def ranked(pairs):
    return sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda p: (-p[2], p[0], p[1]))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=9), st.integers(1, 6), min_size=1, max_size=25), st.integers(1, 12))
def test_batches_equal_single_merges(counts, size):
    want, _ = plain_merges(counts, 60)
    state = {w: [*w[:-1], w[-1] + "</w>"] for w in counts}
    made, got, known, complete = set(), [], None, False
    while len(got) < 60:
        batch = known.batch(made, 60 - len(got)) if known else []
        if not batch:
            top = ranked(pairs_of(state, counts))
            if known and not known.stale and complete or not top:
                break
            complete, top = len(top) < size, top[:size]
            known = bpe.Frontier(top, (-0.5,) if complete else (-top[-1][2], *top[-1][:2]))
            continue
        before = pairs_of(state, counts)
        for left, right, _ in batch:
            for w, syms in state.items():
                text = "".join(f"<{x}>" for x in syms).replace(f"<{left}><{right}>", f"<{left + right}>")
                state[w] = text[1:-1].split("><")
        after = pairs_of(state, counts)
        change = [(*p, after[p] - before[p]) for p in {*before, *after} if after[p] != before[p]]
        products = {a + b for a, b, _ in batch} - made
        made |= products
        known.apply(change, products)
        got += batch
    assert got == want


def test_encode_decode_round_trip(spark, toy):
    counts, df = toy
    vocab, merges, _ = bpe.train(df, vocab_size=None, max_merges=40, min_frequency=5)
    texts = spark.createDataFrame([(0, "abab aaaa  dcba"), (1, ""), (2, None), (3, "aXa")], "i int, text string")
    out = enc.encode(texts, words.words_of(F.col("text")), merges, vocab, bos=100, eos=101)
    rows = {r.i: r.ids for r in out.collect()}
    assert rows[1] == [100, 101] and rows[2] is None
    back = enc.decode(out.where("i = 0").select("i", F.expr("slice(ids, 2, size(ids) - 2)").alias("ids")), F.col("ids"), vocab, ["i"])
    assert back.collect()[0].text == "abab aaaa dcba"
    assert 1 in rows[3]  # X is not in the alphabet
    pieces = enc.pieces_of(enc.encode(texts.where("i = 0"), words.words_of(F.col("text")), merges, vocab), F.col("ids"), vocab, ["i"])
    shown = [r.piece for r in pieces.orderBy("pos").collect()]
    assert "".join(shown) == "ababaaaadcba"
    lexicon = {r.word: r.pieces for r in enc.word_lexicon(df, merges).collect()}
    _, state = plain_merges(counts, 40, 5)
    assert lexicon == state


def test_specials(spark, toy, tmp_path):
    _, df = toy
    vocab, merges, _ = bpe.train(df, vocab_size=None, max_merges=5, min_frequency=1)
    n = vocab.count()
    more = words.add_specials(vocab, ["<|a|>", "<|unk|>", "\n\n"], n)
    ids = {r.token: r.id for r in more.collect()}
    assert ids["<|a|>"] == n and ids["\n\n"] == n + 1 and ids["<|unk|>"] == 1
    save_tokenizer(more, merges, str(tmp_path / "tok"))
    vocab2, merges2 = load_tokenizer(spark, str(tmp_path / "tok"))
    assert sorted(vocab2.collect()) == sorted(more.collect()) and merges2.count() == 5
    text = spark.createDataFrame([("<|a|>abab\n\nab",)], "text string")
    split = enc.words_with_specials(F.col("text"), ["<|a|>", "\n\n"], words.WORD_PATTERN)
    got = enc.encode(text, split, merges2, vocab2).collect()[0].ids
    assert got[0] == n and n + 1 in got


NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


def test_closed_vocabulary(spark):
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(NUMBERS)], "token string, id int")
    df = spark.createDataFrame([(0, "one two three"), (1, " ten\n four "), (2, "")], "i int, text string")
    for limit in (enc.MAX_LOOKUP, 0):
        out = enc.encode_words(df, words.word_list(F.col("text")), vocab, ["i"], unk_id=None, limit=limit)
        assert {r.i: r.ids for r in out.collect()} == {0: [1, 2, 3], 1: [10, 4], 2: []}
        back = enc.decode(out.where("i < 2"), F.col("ids"), vocab, ["i"], "back", word_end=None, limit=limit)
        assert {r.i: r.back for r in back.collect()} == {0: "one two three", 1: "ten four"}
        bad = spark.createDataFrame([(0, "one thousand")], "i int, text string")
        with pytest.raises(Exception, match="thousand"):
            enc.encode_words(bad, words.word_list(F.col("text")), vocab, ["i"], unk_id=None, limit=limit).collect()


def test_word_pattern_keeps_marks_apart(spark):
    df = spark.createDataFrame([("बारेमा एकछिन भुलियो । जयपुर, it's।",)], "t string")
    got = df.select(words.words_of(F.col("t")).alias("w")).collect()[0].w
    assert got == ["बारेमा", "एकछिन", "भुलियो", "।", "जयपुर", ",", "it", "'", "s", "।"]


def test_pattern_pieces_like_the_regex_library(spark):
    import regex

    texts = ["Hello  world, it's 12345!\n\n  next\tline ", "a   b\r\nc  ", "नेपाल १२३४"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r.p for r in df.select(words.pattern_pieces(F.col("t")).alias("p")).collect()]
    assert got == [regex.findall(words.SPLIT_PATTERN, t) for t in texts]


def test_all_words_are_ranked_and_unknown_ids_fail(spark):
    rows = [(f"w{i:03d}", 1 + i % 7) for i in range(300)]
    counts = spark.createDataFrame(rows, "word string, n bigint").repartition(5)
    want = ["<|endoftext|>", "<|unk|>", *[w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]]
    vocab = words.ranked_vocabulary(counts)
    assert sorted((r.id, r.token) for r in vocab.collect()) == list(enumerate(want))
    assert sorted(r.id for r in words.ranked_vocabulary(counts, 10).collect()) == list(range(12))
    df = spark.createDataFrame([(0, [2, 999])], "i int, ids array<int>")
    for limit in (10_000, 0):
        with pytest.raises(Exception, match="id not in vocabulary"):
            enc.decode(df, F.col("ids"), vocab, ["i"], word_end=None, limit=limit).collect()
        assert enc.decode(df, F.col("ids"), vocab, ["i"], word_end=None, limit=limit, unk="?").first().text == f"{want[2]} ?"


def test_long_words_split_like_the_plain_rule():
    from random import Random

    from textloom.operators.encode import _word_pieces

    def plain(word, ranks, end):
        pieces = [*word[:-1], word[-1] + end]
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(pieces, pieces[1:])) if p in ranks]
            if not found:
                return pieces
            _, at = min(found)
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]

    draw = Random(5)
    symbols = ["a", "b", "c", "ab", "ba", "aa", "bc", "aab", "abab", "aaaa", "c</w>", "bc</w>", "a</w>"]
    pairs = [(x, y) for x in symbols for y in symbols if not x.endswith("</w>")]
    for _ in range(200):
        ranks = {p: i for i, p in enumerate(draw.sample(pairs, 30))}
        word = "".join(draw.choices("abc", k=draw.randint(1, 60)))
        assert _word_pieces(word, ranks, "</w>") == plain(word, ranks, "</w>")
    long = _word_pieces("ab" * 100_000, {("a", "b"): 0, ("ab", "ab"): 1}, "</w>")
    assert "".join(long) == "ab" * 100_000 + "</w>" and len(long) == 49_999 + 3  # the last "b" ends the word: abab.., ab, a, b</w>
