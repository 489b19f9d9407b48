"""Looking items up in a table of any size."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from textloom.operators import encode as enc
from textloom.operators import lexicon


@pytest.mark.parametrize(("piece", "chunk"), [(lexicon.PIECE, lexicon.CHUNK), (7, 20), (1, 1)])
def test_like_a_dictionary(spark, monkeypatch, piece, chunk):
    monkeypatch.setattr(lexicon, "FREQUENT", 5)
    rng = random.Random(piece)
    known = {f"w{i}": i for i in range(60)}
    rows = [(i % 20, [f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.choice((0, 1, 7, 8, 30)))], "x" if i % 3 else None) for i in range(80)]
    rows += [(None, None, "null"), (7, [], "empty"), (7, ["w1", None], "hole"), (8, ["w1"] * 200, "hot"), (8, ["w1"] * 200, "hot")]
    df = spark.createDataFrame(rows, "value int, item array<string>, _chunk string").repartition(4)  # names of the operator's own
    vocab = spark.createDataFrame(list(known.items()), "token string, id int")
    out = lexicon.look_up(df, F.col("item"), vocab, "token", "id", "ids", piece=piece, chunk=chunk)
    assert out.columns == ["value", "item", "_chunk", "ids"]
    want = [(v, a, c, None if a is None else [known.get(w) for w in a]) for v, a, c in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    back = lexicon.look_up(out.where("ids IS NOT NULL"), F.col("ids"), vocab, "id", "token", "item", piece=piece, chunk=chunk)
    names = [(v, c, ids, [f"w{i}" if i is not None else None for i in ids]) for v, _, c, ids in want if ids is not None]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, names))
    bad = spark.createDataFrame([(["w1", "w77"],)], "item array<string>")
    with pytest.raises(Exception, match="not in vocabulary: w77"):
        lexicon.look_up(bad, F.col("item"), vocab, "token", "id", "ids", True, piece, chunk).collect()
    assert lexicon.look_up(df.limit(0), F.col("item"), vocab, "token", "id", "ids").count() == 0
    none = lexicon.look_up(df.where("_chunk = 'hot'"), F.col("item"), vocab.limit(0), "token", "id", "ids").first()
    assert none.ids == [None] * 200


def test_both_sides_of_the_limit_agree(spark):
    n = 2000
    vocab = spark.range(n).select(F.concat(F.lit("t"), "id").alias("token"), F.col("id").cast("int").alias("id"))
    df = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.concat(F.lit("t"), (i * F.col("id")) % 2100)).alias("w"))
    found = [enc.encode_words(df, F.col("w"), vocab, ["id"], limit=limit) for limit in (n, n - 1)]
    sent, joined = (sorted((r.id, r.ids) for r in f.collect()) for f in found)
    assert sent == joined and any(enc.UNK_ID in ids for _, ids in sent)
    plan = found[1]._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_carries_arrays_without_nulls(spark):
    """A second look-up carries the array that the first one has made, whose items are known not to be null."""
    vocab = spark.createDataFrame([("a", 0), ("b", 2)], "token string, id int")
    df = spark.createDataFrame([(1, ["a", "c", "b"]), (2, [])], "i int, words array<string>")
    coded = enc.encode_words(df, F.col("words"), vocab, ["i"], unk_id=0, limit=0).select("i", "ids")
    assert not coded.schema["ids"].dataType.containsNull
    back = enc.decode(coded, F.col("ids"), vocab, ["i"], word_end=None, limit=0)
    assert sorted(map(tuple, back.collect())) == [(1, [0, 0, 2], "a a b"), (2, [], "")]


def test_items_found_in_runs_of_rows():
    """Rows are cut into runs of few items; nulls, empty rows and a row longer than a run keep their place."""
    rows = [["a", "b"], None, [], ["b"] * 9, ["a"], None]
    lists = pa.array(rows, pa.list_(pa.string()))
    seen = []

    def found(run):
        seen.append(len(run.flatten()))
        return enc._laid_out(run, pc.index_in(run.flatten(), value_set=pa.array(["a", "b"])))

    out = enc._in_runs(lists, found, pa.list_(pa.int32()), most=3)
    assert out.to_pylist() == [None if r is None else ["ab".index(w) for w in r] for r in rows]
    assert sum(seen) == 12 and max(seen) == 9 and len(seen) > 2
    assert enc._in_runs(lists.slice(3, 2), found, pa.list_(pa.int32()), most=3).to_pylist() == [[1] * 9, [0]]
    assert enc._in_runs(lists.slice(0, 0), found, pa.list_(pa.int32())).to_pylist() == []
