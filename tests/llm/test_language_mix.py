"""Language mixtures: held-out accuracy, a brute-force likelihood, odd rows."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_mix as lm

DATA = "/root/testdata/sf0.01"
EN, DE = "the cat sat on the mat and then it ran off with that hat ", "der hund und die katze sind nicht auf dem dach gewesen "
FR = "le chat est sur la table et les enfants sont dans le jardin "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN * 20, "en"), (DE * 20, "de"), (FR * 20, "fr"), (None, "en"), ("xx", None)]
    return lm.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_are_those_of_all_examples(model):
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(model.probability.astype(float).sum(axis=0), 1, atol=1e-4)


def trigrams(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return lm._trigrams(data, np.array([0, len(data)]))[0]


@pytest.mark.parametrize("text", [EN, DE * 3, EN * 3 + FR * 3, EN * 5 + DE * 2 + FR * 4, "the", "katze sat"])
def test_selection_is_the_best_penalised_set(model, text):
    keys = trigrams(text)
    shares, score = lm.mixture(model, keys)
    p, w = model.probability[keys].astype(float), np.full(len(keys), 1 / lm.OVERLAP)
    penalty = np.log(w.sum() * lm.OVERLAP + 1)
    best = max(
        (lm._proportions(p[:, list(s)], w, np.full(k, 1 / k))[1] - penalty * k, -k, s)
        for k in (1, 2, 3)
        for s in itertools.combinations(range(3), k)
    )[2]
    assert sorted(shares) == [model.languages[i] for i in best]
    assert abs(sum(shares.values()) - 1) < 1e-6 and 0 <= score <= 1


def test_proportions_follow_the_text(model):
    shares, _ = lm.mixture(model, trigrams(EN * 6 + DE * 2))
    letters = {"en": 6 * sum(c.isalpha() for c in EN), "de": 2 * sum(c.isalpha() for c in DE)}
    assert set(shares) == set(letters)
    for lang, n in letters.items():
        assert abs(shares[lang] - n / sum(letters.values())) < 0.05


def test_repeated_keys_count_as_often(model):
    keys = trigrams((EN + FR) * 400)
    assert len(keys) > lm.BUCKETS // 4
    shares, _ = lm.mixture(model, keys)
    few, _ = lm.mixture(model, trigrams((EN + FR) * 10))
    assert all(abs(shares[k] - few[k]) < 0.02 for k in few)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34, -"), (None, EN), (4, "é"), (5, "中文"), (6, DE * 3000), (7, EN), (7, EN), (8, "\U0001f600 !")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id bigint, text string, language string, score double")
    out = lm.identify(docs, model)
    assert out.columns == ["doc_id", "text", "score", "language"]
    got = {(r.doc_id, r.text): r.language for r in out.collect()}
    assert [got[k].lang_pred for k in rows[:3]] == ["und"] * 3 and got[8, "\U0001f600 !"].lang_pred == "und"
    assert got[None, EN].lang_pred == got[7, EN].lang_pred == "en" and got[6, DE * 3000].lang_pred == "de"
    assert got[4, "é"].lang_pred in model.languages and got[5, "中文"].lang_pred in model.languages
    assert out.count() == len(rows) and got[1, None].score == 0 and got[1, None].languages == {}
    assert lm.identify(docs.limit(0), model).count() == 0
    empty = lm.fit(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {r.language.lang_pred for r in lm.identify(docs, empty).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = lm.identify(docs, lm.fit(lm.learning_rows(docs)))
    right = out.where(lm.held_out()).agg(F.avg((F.col("lang") == F.col("language.lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        lm.fit(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"))
