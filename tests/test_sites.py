"""Sites of links and corpus overlap."""

from urllib.parse import urlparse

from pyspark.sql import functions as F

from textloom.functions import names
from textloom.operators import sites

URLS = [
    "https://www.a.com/x?y#z",
    "http://user:pw@b.com:8080/p",
    "//c.com/path",
    "d.com/no/scheme",
    "HTTP://Www.E.com",
    "https://news.www.f.com?q=//g",
    "mailto:x@y.z",
    "",
    "https://m.h.com#frag",
    " https://i.com/lead",
]


def test_site_of_like_urlparse(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, link string")
    got = [r.s for r in df.select("i", names.site_of(F.col("link")).alias("s")).orderBy("i").collect()]
    assert got == [urlparse(u).netloc.replace("www.", "") for u in URLS]
    tidy = df.select("i", names.site_of(F.col("link"), normalize=True).alias("s")).orderBy("i").collect()
    assert tidy[1].s == "b.com" and tidy[4].s == "e.com"


def test_overlap(spark):
    b = spark.createDataFrame(
        [("t1", "https://www.new.com/1"), ("t2", "http://old.com/2"), (None, "https://new.com/3"), ("t4", None), ("t5", "http://[bad/5")],
        "text string, link string",
    )
    known = spark.createDataFrame([("old.com",)], "site string")
    found = sites.distinct_sites(b)
    assert sorted(r.site for r in found.collect()) == ["new.com", "old.com"]
    reasons = {r.link: r.reason for r in sites.unparsable_links(b).collect()}
    assert reasons == {None: "missing", "http://[bad/5": "unbalanced brackets in host"}
    fresh = sites.new_sites(found, known)
    kept = sites.articles_of_sites(b, fresh)
    assert [(r.text, r.link) for r in kept.collect()] == [("t1", "https://www.new.com/1")]
    audit = {r.site: (r.rows_read, r.rows_saved) for r in sites.site_audit(b.dropna(), kept).collect()}
    assert audit["new.com"] == (1, 1) and audit["old.com"] == (1, 0)


def test_articles_are_not_moved_by_site(spark):
    rows = [(i, f"https://s{i % 7 if i % 3 else 0}.com/{i}", "x" * 50) for i in range(500)] + [(900, None, "x"), (901, "http://[bad/5", "x")]
    pages = spark.createDataFrame(rows, "i int, link string, html string")
    kept = spark.createDataFrame([("s0.com",), ("s3.com",), ("s3.com",), (None,), ("none.com",)], "site string")
    want = {i for i, link, _ in rows[:500] if link.split("/")[2] in ("s0.com", "s3.com")}
    for sent in (sites.SENT_SITES, 3, 2):
        found = sites.articles_of_sites(pages, kept, sent=sent)
        assert sorted(r.i for r in found.collect()) == sorted(want)
        if sent > 2:
            assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_sites_of_equal_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions

    pages = spark.createDataFrame([(i, f"https://s{i}.com/") for i in range(40)], "i int, link string")
    kept = spark.createDataFrame([(f"s{i}.com",) for i in range(0, 40, 5)], "site string")
    monkeypatch.setattr(sites.F, "xxhash64", lambda c: functions.crc32(functions.col(c).cast("binary")) % 4)
    found = sites.articles_of_sites(pages, kept)
    assert sorted(r.i for r in found.collect()) == list(range(0, 40, 5))


def test_small_tables_are_spread(spark, tmp_path):
    from textloom.sources.tables import spread_small

    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "few"))
    spark.range(1000).repartition(cores).write.parquet(str(tmp_path / "many"))
    for name, moved in (("few", True), ("many", False)):
        rows = spread_small(spark.read.parquet(str(tmp_path / name)), "id")
        assert rows.count() == 1000
        assert ("Exchange" in rows._jdf.queryExecution().executedPlan().toString()) == moved
    assert spread_small(spark.range(5).toDF("id"), "id").count() == 5


def test_steps_of_names(spark):
    listed = ["model_pg_20_steps.pth", "x/model_pg_7_steps.pth", "model_pg_x_steps.pth", "model_pg_3_interrupted.pth", "other"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(listed)], "i int, n string").orderBy("i")
    got = df.select(names.captured_step(F.col("n")).alias("c"), names.split_step(F.col("n")).alias("s")).collect()
    assert [r.c for r in got] == [20, 7, None, None, None]
    assert [r.s for r in got] == [20, 7, None, None, None]
