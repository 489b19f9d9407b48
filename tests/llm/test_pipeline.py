"""The pipeline against its stages spelled out."""

import random

import public_tokenizers
import pytest
from test_containment import brute as contained
from test_disclosure import base, disclosed, nearby
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _language int, c0 string"
DE, EN = "der hund und die katze auf dem dach mit einem ball".split(), "the dog and a cat on their roof with some ball".split()


def tables(spark, folder):
    rng = random.Random(9)
    prose = lambda w, n: " ".join(rng.choice(w) + rng.choice(["", "s", "er", "ly", "ing", f"{rng.randrange(99)}x"]) for _ in range(n))
    items = [(i, prose(EN, 30)) for i in range(3)] + [(9, None)]
    rows = [[i, prose(EN if i % 3 else DE, rng.randrange(20, 90)), "en" if i % 3 else "de"] for i in range(60)]
    rows += [[100 + i, rows[i][1], "en"] for i in range(8)]
    rows += [[110 + i, f"{prose(EN, 40)} a.b{i}@mail.org +49 170 123456{i} Specialname x@mail.org {prose(EN, 20)}", "en"] for i in range(6)]
    rows += [[120 + i, f"{prose(EN, 12)} {' '.join(items[i][1].split()[4:20])} {prose(EN, 9)}", "en"] for i in range(3)]
    rows += [[130, None, "en"], [131, "", None], [132, "12 34", "de"], [None, prose(EN, 30), None], [133, prose(DE, 9000), "de"], [5, rows[5][1], "en"], [134, "the dog", "en"]]
    rows = [(*r, f"s{i % 2}", len(r[1] or ""), i, "z") for i, r in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [r[:2] for r in rows], items


def redact(rows):
    pairs, out = disclosed(rows), []
    for d, t in rows:
        cuts = [(a, b, f"<{k.upper()}>") for k, a, b, _ in base(t)]
        for e, w, a, b in nearby(t):
            if (e, w) in pairs:
                cuts.append((a, b, "" if pairs[e, w] else "<TERM>"))
        end, text = 0, ""
        for a, b, tag in sorted(set(cuts)):
            text += t[end : max(a, end)] + (tag if b > end else "")
            end = max(end, b)
        out.append((d, text + t[end:]))
    return out


def test_all_stages(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    prints = [brute_fingerprint(t) for _, t in lettered]
    groups = {}
    nodes = brute_components(list(range(len(lettered))), prints)
    for g, r in zip(nodes, lettered, strict=True):
        groups.setdefault(g, []).append(r)
    single = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    hits = [r[2] for r in contained(single, items)]
    clean = redact([r for r, n in zip(single, hits, strict=True) if not n])

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect()))
    plain = lambda rs: sorted((d is None, d or 0, t) for d, t in rs)
    assert kept[0] == plain(lettered)
    assert kept[1] == plain(single)
    assert kept[2] == plain([r for r, n in zip(single, hits, strict=True) if not n])
    assert kept[3] == plain(clean)
    assert any("<EMAIL>" in t and "<TERM>" not in t and "Specialname" not in t for _, t in clean)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault(p.doc_id, []).extend(p.ids)
    assert got == {d: [*encoder.encode(t, add_special_tokens=False).ids, 2] for d, t in clean}


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "z y x w v u"), (None, "z y x w v u"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, root int")
    out = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 1, "a b c d e"), (False, 2, ""), (True, 0, "z y x w v u")]


@pytest.mark.parametrize("labels", [True, False])
def test_no_rows_and_no_labels(spark, tmp_path, labels):
    rows = [(1, "the dog and a cat", None, "s", 17, 1, "z"), (2, "1 2", None, "s", 3, 1, "z")][: 0 if labels else 2]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1] * (not labels)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.partition("_")[0] for n in names} and "pipeline" in names
