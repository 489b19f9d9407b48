"""Packing, splits, batches and chat sequences."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import chat, loader, pack, split, words
from textloom.operators import encode as enc
from textloom.plans import grouped
from textloom.plans.shared_dir import materialise
from textloom.sources.legacy_windows import LEGACY_COLUMN, parse_legacy, to_legacy

NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


def windows_of(ids, max_length, stride):
    return [(k, ids[i : i + max_length], ids[i + 1 : i + max_length + 1]) for k, i in enumerate(range(0, len(ids) - max_length, stride))]


def test_stated_windows(spark):
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(NUMBERS)], "token string, id int")
    lines = spark.createDataFrame(
        [("1", 0, "zero one two three four "), ("1", 1, " five six seven"), ("2", 0, "eight nine ten eleven twelve")],
        "file string, line bigint, text string",
    )
    coded = enc.encode_words(lines, words.word_list(F.col("text")), vocab, ["file", "line"], unk_id=None)
    got = pack.pack(coded, ["file"], "line", max_length=3, stride=2).orderBy("file", "win").collect()
    assert [(r.input_ids, r.target_ids) for r in got] == [
        ([0, 1, 2], [1, 2, 3]),
        ([2, 3, 4], [3, 4, 5]),
        ([4, 5, 6], [5, 6, 7]),
        ([8, 9, 10], [9, 10, 11]),
    ]


@pytest.mark.parametrize("max_length,stride", [(4, 3), (4, 4), (5, 1), (3, 4), (3, 9), (1, 1), (60, 7)])
def test_random_streams(spark, max_length, stride, monkeypatch):
    monkeypatch.setattr(pack, "_ROWS_PER_BUCKET", 8)
    rnd = random.Random(max_length * 10 + stride)
    rows = [(s, i * 3, [rnd.randint(0, 99) for _ in range(rnd.choice([0, 0, 1, 2, 5, 40]))]) for s in "abc" for i in range(50)]
    rows += [("exact", 0, list(range(max_length + 1))), ("short", 0, list(range(max_length)))]
    df = spark.createDataFrame(rows, "s string, o bigint, ids array<int>").repartition(4)
    got = {(r.s, r.win): (r.input_ids, r.target_ids) for r in pack.pack(df, ["s"], "o", max_length=max_length, stride=stride).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        stream = [x for r in rows if r[0] == s for x in r[2]]
        for k, a, b in windows_of(stream, max_length, min(stride, max_length + 1)):
            want[s, k] = (a, b)
        n = spark.range(1).select(pack.n_windows(F.lit(len(stream)), max_length, min(stride, max_length + 1)).alias("n")).collect()[0].n
        assert n == sum(1 for k in want if k[0] == s)
    assert got == want


def test_row_windows(spark):
    rows = [(i, list(range(n))) for i, n in enumerate([0, 3, 4, 5, 30])]
    df = spark.createDataFrame(rows, "d int, ids array<int>")
    for stride in (2, 9):
        got = {(r.d, r.win): (r.input_ids, r.target_ids) for r in pack.pack_rows(df, ["d"], max_length=4, stride=stride).collect()}
        assert got == {(d, k): (a, b) for d, ids in rows for k, a, b in windows_of(ids, 4, stride)}
    with pytest.raises(ValueError):
        pack.pack(df, ["d"], "d", stride=0)


def test_no_task_sees_a_whole_stream(spark, tmp_path):
    df = spark.range(2000).selectExpr("'s' AS s", "id AS o", "array(1, 2, 3) AS ids")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    plan = pack.pack(spark.read.parquet(path), ["s"], "o")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoop" not in plan


def test_legacy_rows(spark):
    df = spark.createDataFrame([('"[1, 2]","[2, 3]"',)], f"`{LEGACY_COLUMN}` string")
    row = parse_legacy(df).collect()[0]
    assert (row.input_ids, row.target_ids) == ([1, 2], [2, 3])
    assert to_legacy(parse_legacy(df)).collect()[0][0] == '"[1, 2]","[2, 3]"'


def test_split_sizes(spark):
    df = spark.range(1).select(
        split.head_size(F.lit(5312289)).alias("a"), split.n_batches(F.lit(3585795), 18).alias("b"),
        split.n_batches(F.lit(398422), 18).alias("c"),
    )
    assert tuple(df.collect()[0]) == (4781060, 3585795 // 18, 398422 // 18)


def test_split_and_batches(spark):
    rows = split.number_rows(spark.range(0, 300, 3).repartition(7), "id")
    parts = materialise(split.positional_split(rows), "test")
    counts = split.reconcile(parts, rows).collect()[0]
    assert (counts.n_train, counts.n_test, counts.agrees) == (90, 10, True)
    with pytest.raises(Exception, match="do not add up"):
        split.reconcile(parts.where("rn > 5"), rows).collect()
    assert parts.where("split = 'train'").agg(F.max("id")).collect()[0][0] == 267
    whole = split.batches(rows, 16)
    assert (whole.count(), split.batches(rows, 16, drop_last=False).count()) == (96, 100)
    assert split.resume(whole, 14, 6).agg(F.min("batch_id")).collect()[0][0] == 2
    epochs = split.repeat_epochs(whole, 2, split.n_batches(F.col("n_rows"), 16))
    assert epochs.agg(F.max("step"), F.count("*")).collect()[0][:] == (11, 192)


def test_collate(spark):
    rows = [(i, i // 3, [i, i + 1], [i + 1, i + 2]) for i in range(7)]
    df = spark.createDataFrame(rows, "rn bigint, batch_id bigint, input_ids array<int>, target_ids array<int>").repartition(3)
    got = {r.batch_id: r.input_ids for r in split.collate(df).collect()}
    assert got == {0: [[0, 1], [1, 2], [2, 3]], 1: [[3, 4], [4, 5], [5, 6]], 2: [[6, 7]]}
    uneven = df.withColumn("input_ids", F.when(F.col("rn") == 4, F.array(F.lit(1))).otherwise(F.col("input_ids")))
    with pytest.raises(Exception, match="differ in length"):
        split.collate(uneven).collect()


def test_shuffle_and_hash_split(spark):
    df = spark.range(1000)
    order = [r.id for r in split.shuffled_numbers(df, ["id"]).orderBy("rn").collect()]
    assert sorted(order) == list(range(1000)) and order != list(range(1000))
    again = [r.id for r in split.shuffled_numbers(df.repartition(13), ["id"]).orderBy("rn").collect()]
    assert order == again
    assert order != [r.id for r in split.shuffled_numbers(df, ["id"], seed=1).orderBy("rn").collect()]
    share = split.hash_split(df, ["id"]).where("split = 'train'").count()
    assert 860 < share < 940


def test_split_text(spark):
    row = split.split_text(spark.createDataFrame([("abcdefghij\n",)], "text string")).collect()[0]
    assert (row.train_text, row.test_text) == ("abcdefghi", "j\n")


def test_chat(spark):
    df = spark.createDataFrame([("c", t, "user" if t % 2 == 0 else "assistant", f" said {t}\n") for t in range(5)], "conv_id string, turn bigint, role string, text string")
    whole = chat.render_conversations(df).collect()
    assert len(whole) == 1 and whole[0].n_turns == 5
    parts = chat.render_conversations(df.repartition(3), turns_per_part=2).orderBy("part").collect()
    assert [p.n_turns for p in parts] == [2, 2, 1]
    assert "".join(p.text for p in parts) == whole[0].text
    assert whole[0].text.startswith("<|start_header_id|>user<|end_header_id|>\n\nsaid 0<|eot_id|><|start_header_id|>assistant")
    one = spark.createDataFrame([("लामा हरु ले के खान्छन् ?",)], "t string").select(chat.turn_text(F.col("t")).alias("s")).collect()[0].s
    assert one == "<|start_header_id|>प्रयोगकर्ता<|end_header_id|>\n\nलामा हरु ले के खान्छन् ?<|eot_id|>"


def test_chat_ids(spark):
    special = {t: 50000 + i for i, t in enumerate(chat.CHAT_SPECIALS)}
    ids = spark.range(1).select(chat.turn_ids(F.array(F.lit(7)), F.array(F.lit(8), F.lit(9)), special).alias("i")).collect()[0].i
    assert ids == [50002, 7, 50003, 50005, 8, 9, 50004]


def test_text_loader(spark):
    texts = {i: "".join(chr(97 + (i * j) % 7) for j in range(n)) for i, n in enumerate([0, 30, 100, 41])}
    df = spark.createDataFrame(list(texts.items()), "d bigint, text string")

    def letters(t):  # one id per character
        codes = F.transform(F.regexp_extract_all("text", F.lit("."), F.lit(0)), lambda c: F.ascii(c))
        return t.withColumn("ids", codes)

    got = loader.text_batches(df, letters, "d", batch_size=5, max_length=5, stride=3).collect()
    want = {"train": [], "validation": []}
    for i, t in texts.items():
        cut = int(len(t) * 0.9)
        for name, part in (("train", t[:cut]), ("validation", t[cut:])):
            want[name] += [(i, k, a, b) for k, a, b in windows_of([ord(c) for c in part], 5, 3)]
    rows = {s: sorted((r.rn, r.batch_id, r.d, r.win, r.input_ids, r.target_ids) for r in got if r.split == s) for s in want}
    assert [r[2:] for r in rows["validation"]] == want["validation"]
    assert [r[1] for r in rows["validation"]] == [i // 5 for i in range(len(want["validation"]))]
    n_train = len(want["train"]) // 5 * 5
    assert [r[0] for r in rows["train"]] == list(range(n_train)) and n_train < len(want["train"])
    seen = [r[2:] for r in rows["train"]]
    assert all(r in want["train"] for r in seen) and seen != want["train"][:n_train]


def test_conversation_of_any_length(spark, monkeypatch):
    rows = [(1, t, None if t % 50 == 0 else "user", f"turn {t}" if t % 7 else None) for t in range(5000)]
    rows += [(2, 0, "user", " a "), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(6)

    def said(role, text):
        return f"<|start_header_id|>{role or chat.USER_ROLE}<|end_header_id|>\n\n{(text or '').strip()}<|eot_id|>"

    whole = {c: [said(r, x) for k, _, r, x in rows if k == c] for c in (1, 2)}
    for hot in (grouped.HOT_ROWS, 100):
        monkeypatch.setattr(grouped, "HOT_ROWS", hot)
        monkeypatch.setattr(grouped, "ROWS_PER_RANGE", 500)
        got = chat.placed_turns(df).orderBy("conv_id", "turn").collect()
        assert [r.text for r in got] == whole[1] + whole[2]
        assert all(r.n_chars == len("".join(whole[r.conv_id])) for r in got)
        assert all("".join(whole[r.conv_id])[r.start : r.start + len(r.text)] == r.text for r in got)
        assert [r.start for r in got if r.conv_id == 2] == [0, len(whole[2][0])]
    ids = df.select("conv_id", "turn", F.array("turn", F.col("turn") + 1).alias("ids"))
    windows = {(r.conv_id, r.win): r.input_ids for r in chat.conversation_windows(ids, max_length=9, stride=7).collect()}
    stream = [x for t in range(5000) for x in (t, t + 1)]
    assert windows == {(1, k): a for k, a, _ in windows_of(stream, 9, 7)}
