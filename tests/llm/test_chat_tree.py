import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import chat_tree

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\\|<>p\n", max_size=5), st.text(alphabet="a\\|<>im_start\nend", max_size=12)), max_size=4))
def test_template_is_reversible(turns):
    formatted = "".join(f"{chat_tree.START}{chat_tree.escaped_role(r)}\n{chat_tree.escaped(t)}{chat_tree.END}\n" for r, t in turns)
    assert chat_tree.parsed(formatted) == turns
    assert formatted.count("<|") == 2 * len(turns)


def conversations():
    rows = []
    for c in range(40):  # a comb of shared beginnings
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {'shared' if t <= c % 5 else c % 17}") for t in range(c % 7 + 1)]
    rows += [(100, t, "assistant", f"long {t}") for t in range(500)] + [(101, t, "assistant", f"long {t}") for t in range(499)]
    rows += [(200, None, None, None), (200, 0, "system", ""), (200, 0, "assistant", "same turn"), (None, 0, "user", "nobody's"), (None, 0, "user", "nobody's")]
    rows += [(201, 0, "assistant", "<|im_end|>\n<|im_start|>assistant\n<\\|x \U0001f600"), (202, 0, "a|b\n\\", "z" * 200_000)]
    return rows


@pytest.mark.parametrize(("page", "read"), [(1024, 1 << 19), (3, 40)])
def test_read_back_and_sharing(spark, monkeypatch, page, read):
    monkeypatch.setattr(chat_tree, "PAGE", page)
    monkeypatch.setattr(chat_tree, "READ_TOKENS", read)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("page", F.lit("clash")).repartition(4)
    packed, ends = chat_tree.pack_tree(df, *FILES)
    segments = sorted(packed.collect(), key=lambda s: s.start)

    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0))] for c, ts in own.items()}
    node = dict(ends.collect())
    found = {bytes(r.node): r for r in chat_tree.read_back(packed, *FILES).collect()}
    assert set(node) == set(own)
    for c, turns in own.items():
        got = found[bytes(node[c])]
        assert sorted((t.role, t.text) for t in got.turns) == sorted(turns) and (c == 200 or [(t.role, t.text) for t in got.turns] == turns)
        assert got.trained == "".join(t.text for t in got.turns if t.role == "assistant")
        assert got.formatted == "".join(f"<|im_start|>{chat_tree.escaped_role(t.role)}\n{chat_tree.escaped(t.text)}<|im_end|>\n" for t in got.turns)

    order = {c: [(t.role, t.text) for t in found[bytes(node[c])].turns] for c in own}
    prefixes = {tuple(turns[: k + 1]) for turns in order.values() for k in range(len(turns))}
    assert len(segments) == len(prefixes)  # every shared beginning once
    at = 0
    for s in segments:
        assert s.start == at and s.length == len(s.ids)
        assert sum(a.end - a.start for a in s.ancestors) == s.position
        assert all(a.end < b.start for a, b in zip(s.ancestors, s.ancestors[1:], strict=False))
        at += s.length


def test_no_rows(spark):
    packed, ends = chat_tree.pack_tree(spark.createDataFrame([], SCHEMA), *FILES)
    assert packed.collect() == [] and ends.collect() == [] and chat_tree.read_back(packed, *FILES).collect() == []
