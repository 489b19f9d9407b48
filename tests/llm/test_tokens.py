"""Token ids, packing and the scan of flat files against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import packing, texts, token_scan, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
DIRECT = Tokenizer.from_file(PATH)


def ids_of(text, end=2):
    return [*DIRECT.encode(text or "", add_special_tokens=False).ids, end]


ODD = [
    None, "", " \t\n", "Hello, WORLD it's don't ''s ,'ll", "naïve é İstanbul ß ẞ", "a b c\u0085d", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "12 345 6-7_8", "\U0001f600\U0001f600 中文 क्ष", "a ́b \ń", "x" * 3000, "\x1c\x1fq", "A\x0bB\x0cC\rD", "word. Word, word; wOrd",
]


@pytest.mark.parametrize("memo", [48 << 20, 2000, 5])
def test_ids_equal_those_of_whole_texts(monkeypatch, memo):
    monkeypatch.setattr(tokens, "MEMO_BYTES", memo)
    own = tokens.WordTokenizer(PATH)
    for _ in range(2):
        for words in texts.split(pa.array(ODD, pa.string()), texts.SPACES):
            ids, begin = own.encode(words, 2)
            got = [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)]
            assert got == [ids_of(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_ids_of_any_text(batch):
    own = tokens.WordTokenizer.load(PATH)
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    for words in texts.split(pa.array(batch, pa.string()), texts.SPACES):
        ids, begin = own.encode(words, 2)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [ids_of(t) for t in batch]


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 100):
        sizes = rng.integers(1, 50, n)
        at, offset = packing.first_fit_decreasing(sizes, 64)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(64)
            want[i] = (b, 64 - room[b])
            room[b] -= sizes[i]
        assert [(a, o) for a, o in zip(at, offset, strict=True)] == [want[i] for i in range(n)]


def rows(n=300):
    rng = np.random.default_rng(3)
    out = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "same"), (None, "same"), (None, None), (5, "lo ng " * 9000)]
    return out + [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 99, int(rng.integers(0, 200))))) for i in range(n)]


def test_every_id_lies_in_one_piece(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id bigint, text string, length string, _row int").repartition(3)
    out = packing.pack(docs, PATH).collect()
    assert set(out[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"}
    for r in out:
        assert r.length == len(r.ids) > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    got, want = {}, {}
    for r in sorted(out, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    for d, t in data:
        want.setdefault(d, []).extend(ids_of(t))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    single = [d for d in want if d is not None and sum(x[0] == d for x in data) == 1]
    assert all(got[d] == want[d] for d in single)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= 1.02 * sum(map(len, want.values())) / packing.CAPACITY + 1


def test_small_groups_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    docs = spark.createDataFrame(rows(50), "doc_id bigint, text string")
    out = packing.pack(docs, PATH, with_ids=False)
    assert "ids" not in out.columns
    assert out.agg({"length": "sum"}).first()[0] == sum(len(ids_of(t)) for _, t in rows(50))
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("block", [token_scan.BLOCK_TOKENS, 7, 1])
def test_counts_of_flat_files(spark, block):
    data = rows(20) if block > 1 else rows(0)[:12]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, file string").repartition(3)
    files, documents = token_scan.write_token_files(docs, PATH, 49407)
    found = token_scan.token_counts(files, 49407, block=block)
    joined = found.join(documents, ["file", "document"]).collect()
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    want = [(d, len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in data]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_tokens) for r in joined), key=key) == sorted(want, key=key)
    assert all(r.ended for r in joined) and found.count() == len(data)


def test_scan_of_hand_made_files(spark, tmp_path):
    files = {"a": [9, 1, 2, 9, 3, 3, 3, 3, 3, 3, 9, 9, 5], "b": [1, 1, 1], "c": [], "d": [9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    table = [(str(tmp_path / n), len(ids), 0) for n, ids in files.items()] * 2 + [(None, 3, 0)]
    df = spark.createDataFrame(table, "file string, n_tokens bigint, start int")
    for block in (1, 2, 3, 100):
        found = token_scan.token_counts(df, 9, block=block).collect()
        assert sorted((r.file[-1], r.document, r.start, r.n_tokens, r.ended) for r in found) == [
            ("a", 0, 0, 0, True), ("a", 1, 1, 2, True), ("a", 2, 4, 6, True), ("a", 3, 11, 0, True), ("a", 4, 12, 1, False), ("b", 0, 0, 3, False), ("d", 0, 0, 0, True),
        ]
    assert token_scan.token_counts(df.limit(0), 9).count() == 0
