"""Scans, sinks, run-log arithmetic and the streaming job."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import schedule
from textloom.functions import text as tx
from textloom.operators import ranking, runs
from textloom.sinks import writers
from textloom.sources import tables, text_files
from textloom.sources.text_files import scan_lines, scan_stream_lines, scan_whole_files
from textloom.streaming.clean_stream import append_cleaned, read_new_files

TEXTS = ["plain", 'quoted "x", comma', "two\nlines\n", " edges ", "", None, "क" * 50_000, "a\r\nb", "c\rd", "\\ back \\", "tab\t\"q\""]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "unused") for i, t in enumerate(TEXTS)], "i int, t string, u string")
    path = str(tmp_path / "csv")
    writers.write_csv(df, path)
    back = tables.scan_csv(spark, path, df.schema, ["i", "t"])
    got = {r.i: r.t for r in back.collect()}
    assert {i: t or None for i, t in got.items()} == {i: t or None for i, t in enumerate(TEXTS)}
    assert back.where(tables.non_empty("t")).count() == 9


def test_csv_delimiter_and_types(spark, tmp_path):
    path = str(tmp_path / "tsv")
    writers.write_csv(spark.createDataFrame([(1, 2.5, "a,b")], "i int, x double, s string"), path, sep="\t")
    back = tables.scan_csv_inferred(spark, path, sep="\t")
    assert dict(back.dtypes) == {"i": "int", "x": "double", "s": "string"}
    one = tables.scan_csv_inferred(spark, path, sep=";")  # the wrong delimiter gives one column
    assert len(one.columns) == 1


def test_inferred_types_widen_where_a_row_does_not_fit(spark, tmp_path):
    rows = [f"{i},{i},{i}.5,2024-01-{1 + i % 9:02d},{i}" for i in range(200)] + ['x7,1.5,"a ""b"", c",late,5000000000']
    (tmp_path / "a.csv").write_text("k,v,w,day,n\n" + "\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "same.csv").write_text("_record,v\n1,\n2,3\n", encoding="utf-8")
    got = tables.scan_csv_inferred(spark, str(tmp_path / "a.csv"), sample=0.05)
    types = dict(got.dtypes)
    out = got.collect()
    assert len(out) == 201 and types["k"] == "string" and types["v"] == "double" and types["w"] == "string"
    assert types["day"] == "string" and types["n"] == "bigint"
    last = [r for r in out if r.k == "x7"][0]
    assert (last.v, last.w, last.day, last.n) == (1.5, 'a "b", c', "late", 5_000_000_000)
    assert sum(r.v for r in out) == sum(range(200)) + 1.5
    same = tables.scan_csv_inferred(spark, str(tmp_path / "same.csv"))
    assert [tuple(r) for r in same.collect()] == [(1, None), (2, 3)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.scan_csv_inferred(spark, str(tmp_path / "bad.csv")).collect()


def test_lines_in_order(spark, tmp_path):
    lines = [f" line {i} " for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("x\n\ny", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.line, r.text) for r in got if r.file.endswith("a.txt"))
    assert a == [(i, t.strip()) for i, t in enumerate(lines)]
    assert sorted((r.line, r.text) for r in got if r.file.endswith("b.txt")) == [(0, "x"), (1, ""), (2, "y")]
    whole = {r.file[-5:]: r.text for r in scan_whole_files(spark, str(tmp_path)).collect()}
    assert whole["b.txt"] == "x\n\ny"


def test_numbering_lines_moves_no_text(spark, tmp_path, monkeypatch):
    (tmp_path / "s=1").mkdir()
    for name in "ba":
        (tmp_path / "s=1" / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(900)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        for sent in (text_files.SENT_BLOCKS, 0):
            monkeypatch.setattr(text_files, "SENT_BLOCKS", sent)
            lines = scan_stream_lines(spark, str(tmp_path), "s")
            assert [r.text for r in lines.orderBy("line").collect()] == [f"{n}{i}" for n in "ab" for i in range(900)]
            assert [r.line for r in lines.orderBy("line").collect()] == list(range(1800))
            if sent:
                assert "hashpartitioning" not in lines._jdf.queryExecution().executedPlan().toString()
        scan = scan_stream_lines(spark, str(tmp_path), "s")
        (tmp_path / "s=1" / "a.txt").write_text("x\n" * 3000, encoding="utf-8")  # more lines in the same blocks
        with pytest.raises(Exception, match="files changed"):
            scan.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sql_over_a_file_leaves_views_alone(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "t"))
    spark.range(2).createOrReplaceTempView("data")
    try:
        got = tables.sql_over_file(spark, str(tmp_path / "t"), "WITH x AS (SELECT id FROM data WHERE id > 2) SELECT count(*) AS n FROM x")
        assert got.first().n == 4 and spark.table("data").count() == 2
    finally:
        spark.catalog.dropTempView("data")


def test_corpus_text_in_order(spark, tmp_path):
    df = spark.createDataFrame([("s", i, f"article {i}") for i in range(300)], "s string, o bigint, text string").repartition(6)
    path = tmp_path / "corpus"
    writers.write_corpus(df, str(path), "s", "o")
    files = sorted((path / "s=s").glob("*.txt"))
    written = "".join(f.read_text() for f in files)
    assert written == "".join(f"article {i} <|endoftext|>\n" for i in range(300))


def test_append_and_splits(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 9, "train").otherwise("test"))
    writers.append_table(df, path)
    writers.append_table(df, path)
    assert spark.read.parquet(path).count() == 20
    out = str(tmp_path / "s")
    writers.write_splits(df, out)
    test = spark.read.parquet(out).where("split = 'test'")
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
    both = tables.scan_splits(spark, {"train": f"{out}/split=train", "test": f"{out}/split=test"})
    assert {r.split: r.n for r in both.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 9, "test": 1}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = T.StructType.fromDDL("i bigint, t string")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    texts = ["<b>क</b>, 1 x", "ख॥ \n ग.", ""]
    clean = lambda df: df.select("i", tx.clean(F.col("t")).alias("t"))
    first = spark.createDataFrame(list(enumerate(texts)), schema)
    first.repartition(3).write.parquet(source)
    append_cleaned(read_new_files(spark, source, schema), clean, out, mark)
    more = spark.createDataFrame([(9, "नयाँ")], schema)
    more.write.mode("append").parquet(source)
    append_cleaned(read_new_files(spark, source, schema), clean, out, mark)
    assert sorted(spark.read.parquet(out).collect()) == sorted(clean(first.union(more)).collect())


def test_learning_rate(spark):
    def rate(step, total, initial=1e-5, peak=2e-4, floor=2e-5):
        warm = int(0.02 * total)
        held, last = warm + int(0.15 * total), int(0.9 * total)
        if step < warm:
            return initial + step * (peak - initial) / warm
        if step < held:
            return peak
        if step >= last:
            return floor
        return floor + (peak - floor) / 2 * (1 + math.cos(math.pi * (step - held) / (last - held)))

    got = spark.range(1195).select(schedule.learning_rate(F.col("id"), 1195).alias("x")).collect()
    assert [r.x for r in got] == pytest.approx([rate(s, 1195) for s in range(1195)])
    short = spark.range(3).select(schedule.learning_rate(F.col("id"), 3).alias("x")).collect()  # no warm-up step
    assert short[0].x == pytest.approx(2e-4)


def test_durations(spark):
    cases = {0: "0 second", 1: "1 second", 61: "1 minute, 1 second", 3600: "1 hour", 2 * 86400 + 7325: "2 days, 2 hours, 2 minutes, 5 seconds"}
    df = spark.createDataFrame([(s,) for s in cases], "s bigint")
    got = {r.s: r.t for r in df.select("s", schedule.duration_text(F.lit(0), F.col("s")).alias("t")).collect()}
    assert got == cases
    row = df.where("s = 3600").select(schedule.hms(F.col("s") + 62.5).alias("h")).collect()[0].h
    assert tuple(row) == (1, 1, 2)


def test_mean_of_first_batches(spark):
    df = spark.createDataFrame([("train", i, float(i)) for i in range(10)], "split string, batch_id bigint, loss double")
    got = {r.split: r.mean_loss for r in runs.mean_first_batches(df, ["train", "validation"], 4).collect()}
    assert got["train"] == 1.5 and math.isnan(got["validation"])
    assert runs.mean_first_batches(df, ["train"], None).collect()[0].mean_loss == 4.5


def test_latest_artifact(spark):
    rows = [("r", 0, "model_pg_5_steps.pth"), ("r", 1, "d/model_pg_20_steps.pth"), ("r", 2, "model_pg_20_steps.pth"),
            ("r", 3, "model_pg_x_steps.pth"), ("z", 4, "model_pg_0_steps.pth")]
    got = runs.latest_artifact(spark.createDataFrame(rows, "g string, o bigint, name string"), ["g"], "name", "o").collect()
    assert [(r.g, r.name, r.step) for r in got] == [("r", "d/model_pg_20_steps.pth", 20)]


def test_epochs_and_context(spark):
    row = spark.range(1).select(
        runs.epoch_position(F.lit(25).cast("bigint"), 10).alias("a"), runs.epoch_position(F.lit(10).cast("bigint"), 10).alias("b"),
        runs.epoch_number(F.lit(25), 10).alias("c"), ranking.last_items(F.array(*map(F.lit, range(5))), 3).alias("d"),
        ranking.last_items(F.array(F.lit(1)), 3).alias("e"),
    ).collect()[0]
    assert tuple(row) == (5, 0, 2, [2, 3, 4], [1])


def test_weighted_draw_follows_the_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("item"))
    df = df.withColumn("prob", F.when(F.col("item") == 0, 0.6).when(F.col("item") == 1, 0.4).otherwise(0.0))
    n = {r.item: r.n for r in ranking.weighted_draw(df, ["g"]).groupBy("item").agg(F.count("*").alias("n")).collect()}
    assert 2 not in n and abs(n[0] / 6000 - 0.6) < 0.03


def test_counters_of_a_job(spark):
    df, seen = runs.counted(spark.range(25), "clean", last=F.max("id"))
    df.where("id % 2 = 0").agg(F.sum("id")).collect()
    assert seen.get == {"rows": 25, "last": 24}


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_of_a_table_beside_others(spark, tmp_path, parts):
    """The table is one file, or a folder of files; its neighbour is not read."""
    source, table = tmp_path / "in", tmp_path / "in/docs.parquet"
    spark.range(9, 12).write.parquet(str(tmp_path / "in/docs2.parquet"))
    if parts:
        spark.range(0, 9, 1, parts).write.parquet(str(table))
    else:
        spark.range(0, 9, 1, 1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("part-*.parquet")).rename(table)
    stream = read_new_files(spark, str(source), T.StructType.fromDDL("id bigint"), "docs.parquet")
    append_cleaned(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))
