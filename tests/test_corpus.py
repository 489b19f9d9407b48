"""From raw articles to numbered training windows, as in the README."""

import random

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bpe, encode, pack, split, words
from textloom.plans.shared_dir import materialise


def test_articles_to_windows(spark):
    rnd = random.Random(2)
    letters = "कखगघचजटडतदनपबमयरलवस"
    vocab_words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    # one source holds most of the articles
    rows = [
        ("big" if i % 4 else "small", i, "<p>" + " ".join(rnd.choice(vocab_words) for _ in range(rnd.randint(0, 60))) + "। 12 x</p>")
        for i in range(200)
    ]
    docs = spark.createDataFrame(rows, "source string, ord bigint, text string")
    clean = materialise(docs.select("source", "ord", tx.clean(F.col("text")).alias("text")), "clean")
    vocab, merges, _ = bpe.train_on_text(clean, vocab_size=120, min_frequency=2)
    ids = encode.encode(clean, words.words_of(F.col("text")), merges, vocab, eos=0)
    tokens = materialise(pack.with_sizes(ids.select("source", "ord", "ids")), "tokens")
    numbered = pack.pack(tokens, ["source"], "ord", max_length=16, stride=12, n_ids="n_ids", numbered=True)
    got = split.positional_split(numbered, 0.9).orderBy("rn").collect()

    stream = {s: [] for s in ("big", "small")}
    for r in tokens.orderBy("ord").collect():
        assert r.ids[-1] == 0 and 1 not in r.ids
        stream[r.source] += r.ids
    want = [(s, a[i : i + 16]) for s, a in sorted(stream.items()) for i in range(0, len(a) - 16, 12)]
    assert [(r.source, r.input_ids) for r in got] == want
    assert [r.rn for r in got] == list(range(len(want)))
    assert sum(r.split == "train" for r in got) == int(len(want) * 0.9)
