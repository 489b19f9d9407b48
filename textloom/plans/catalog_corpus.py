"""Queries over scans, sinks, sites and the streaming job."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as tx
from textloom.functions.names import site_of
from textloom.operators import sites
from textloom.plans.catalog_text import LATIN, sql_collapse, sql_html, sql_keep_script, sql_standardise, sql_strip
from textloom.plans.registry import query, table, text_table
from textloom.plans.shared_dir import fresh_path
from textloom.sinks import writers
from textloom.sources import tables as scans
from textloom.sources.tables import spread_small
from textloom.sources.text_files import scan_stream_lines, scan_whole_files
from textloom.streaming.clean_stream import append_cleaned, read_new_files

# -- scans and sinks ------------------------------------------------------------


@query(
    "scan_split_files",
    "A1 A7",
    """SELECT 'train' AS split, doc_id, text FROM documents
       UNION ALL SELECT 'test', item_id, text FROM benchmark""",
)
def _(spark, d):
    paths = {"train": f"{d}/documents.parquet", "test": f"{d}/benchmark.parquet"}
    return scans.scan_splits(spark, paths, {"train": ("doc_id", "text"), "test": ("item_id", "text")})


@query("sql_row_count", "A6 J1", "SELECT count(*) AS n FROM documents")
def _(spark, d):
    return scans.sql_over_file(spark, f"{d}/documents.parquet", "SELECT count(*) AS n FROM data")


@query("csv_round_trip", "A2 B1 C1", "SELECT doc_id, text FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    path = fresh_path(spark, "documents-csv")
    writers.write_csv(docs, path)
    return scans.scan_csv(spark, path, docs.schema, ["doc_id", "text"])


@query("csv_rows_with_text", "A3 C4", "SELECT doc_id, lang FROM documents WHERE text <> '' AND lang <> ''")
def _(spark, d):
    docs = table(spark, d, "documents")
    path = fresh_path(spark, "documents-csv")
    writers.write_csv(docs, path)
    rows = scans.scan_csv(spark, path, docs.schema, ["doc_id", "text", "lang"])
    return rows.where(scans.non_empty("text", "lang")).select("doc_id", "lang")


@query(
    "csv_inferred_types",
    "A9",
    """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance,
       max(c_custkey) AS last_key FROM customer GROUP BY c_mktsegment""",
)
def _(spark, d):
    path = fresh_path(spark, "customer-tsv")
    writers.write_csv(table(spark, d, "customer"), path, sep="\t")
    rows = scans.scan_csv_inferred(spark, path, sep="\t", sample=0.5)
    return rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"),
        F.max("c_custkey").cast("bigint").alias("last_key"),
    )


@query("csv_to_parquet", "B4", "SELECT doc_id, lang, text FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    csv, out = fresh_path(spark, "documents-csv"), fresh_path(spark, "documents-parquet")
    writers.write_csv(docs, csv)
    writers.csv_to_parquet(scans.scan_csv(spark, csv, docs.schema, docs.columns), out)
    return spark.read.parquet(out).select("doc_id", "lang", "text")


_LINES_SQL = f"""SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS line, {sql_strip('x')} AS text
       FROM (SELECT source, doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i
             FROM (SELECT source, doc_id, string_split(text || ' <|endoftext|>', chr(10)) AS a FROM documents))"""


@query("corpus_text_lines", "A4 B2 L3", _LINES_SQL)
def _(spark, d):
    path = fresh_path(spark, "corpus-text")
    writers.write_corpus(table(spark, d, "documents"), path, "source", "doc_id")
    return scan_stream_lines(spark, path, "source")


@query(
    "whole_text_files",
    "A5",
    """SELECT source, CAST(sum(length(text) + 15) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_docs
       FROM documents GROUP BY source""",
)
def _(spark, d):
    path = fresh_path(spark, "corpus-text")
    writers.write_corpus(table(spark, d, "documents"), path, "source", "doc_id")
    files = scan_whole_files(spark, path).select(F.regexp_extract("file", "/source=([^/]*)/", 1).alias("source"), "text")
    marks = F.size(F.split("text", r"<\|endoftext\|>", -1)) - 1
    return files.groupBy("source").agg(
        F.sum(F.length("text")).alias("n_chars"), F.sum(marks.cast("bigint")).alias("n_docs")
    )


@query(
    "preview_rows",
    "A10",
    "SELECT doc_id, substr(text, 1, 1000) AS text FROM documents ORDER BY doc_id LIMIT 5",
)
def _(spark, d):
    return scans.first_rows(table(spark, d, "documents"), "doc_id", 5).select("doc_id", scans.first_chars(F.col("text")).alias("text"))


@query(
    "append_to_table",
    "B3",
    """SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars
       FROM (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'item', text FROM benchmark) GROUP BY kind""",
)
def _(spark, d):
    path = fresh_path(spark, "appended")
    writers.append_table(table(spark, d, "documents").select(F.lit("document").alias("kind"), "text"), path)
    writers.append_table(table(spark, d, "benchmark").select(F.lit("item").alias("kind"), "text"), path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# -- sites ----------------------------------------------------------------------

_SITE = "replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), 'www.', '')"
# The other corpus: pages linked with a www. address. Its sites are the known ones.
_KNOWN_SQL = f"SELECT DISTINCT {_SITE} AS site FROM pages WHERE contains(url, '://www.')"


def _links(spark, d):
    return table(spark, d, "pages").withColumnRenamed("url", "link")


def _known(spark, d):
    return sites.distinct_sites(_links(spark, d).where(F.contains("link", F.lit("://www."))))


def _new(spark, d):
    return sites.new_sites(sites.distinct_sites(_links(spark, d)), _known(spark, d))


@query("site_of_link", "E1", f"SELECT page_id, {_SITE} AS site FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", site_of(F.col("url")).alias("site"))


@query("distinct_links", "E2", "SELECT DISTINCT url AS link FROM pages")
def _(spark, d):
    return sites.distinct_links(_links(spark, d))


@query("distinct_sites", "E3", f"SELECT DISTINCT {_SITE} AS site FROM pages")
def _(spark, d):
    return sites.distinct_sites(_links(spark, d))


@query(
    "unparsable_links",
    "E3",
    """SELECT DISTINCT replace(url, '://', '://[') AS link, 'unbalanced brackets in host' AS reason
       FROM pages WHERE contains(url, '://m.')""",
)
def _(spark, d):
    # break the mobile links, as a bad crawl would
    broken = F.when(F.contains("link", F.lit("://m.")), F.replace("link", F.lit("://"), F.lit("://["))).otherwise(F.col("link"))
    return sites.unparsable_links(_links(spark, d).withColumn("link", broken))


@query("count_links_and_sites", "J2", f"SELECT count(DISTINCT url) AS n_links, count(DISTINCT {_SITE}) AS n_sites FROM pages")
def _(spark, d):
    return _links(spark, d).agg(F.countDistinct("link").alias("n_links"), F.countDistinct(site_of(F.col("link"))).alias("n_sites"))


@query("sites_not_in_other_corpus", "E4", f"SELECT DISTINCT {_SITE} AS site FROM pages EXCEPT ({_KNOWN_SQL})")
def _(spark, d):
    return _new(spark, d)


_KEPT_SQL = f"""SELECT page_id, url, html FROM pages WHERE {_SITE} NOT IN ({_KNOWN_SQL})"""


@query("articles_of_new_sites", "E5 C2 C3", f"SELECT page_id, url AS link FROM ({_KEPT_SQL})")
def _(spark, d):
    pages = _links(spark, d).select("page_id", "link", "html")
    return sites.articles_of_sites(pages, _new(spark, d)).select("page_id", "link")


@query(
    "site_audit",
    "E6 J11",
    f"""SELECT site, CAST(count(*) AS BIGINT) AS rows_read,
        CAST(count(*) FILTER (WHERE site NOT IN ({_KNOWN_SQL})) AS BIGINT) AS rows_saved
        FROM (SELECT {_SITE} AS site FROM pages) GROUP BY site""",
)
def _(spark, d):
    pages = _links(spark, d).select("page_id", "link")
    return sites.site_audit(pages, sites.articles_of_sites(pages, _new(spark, d)))


def _sql_clean(x: str) -> str:
    return sql_collapse(sql_keep_script(sql_standardise(x), LATIN))


def _cleaned_corpora(spark, d):
    pages = sites.articles_of_sites(_links(spark, d).select("page_id", "link", "html"), _new(spark, d))
    return sites.concat_corpora(
        {"a": text_table(spark, d, "documents"), "b": spread_small(pages, "page_id")},
        {
            "a": tx.with_suffix(tx.clean(F.col("text"), tx.LATIN, digits=None, markup=False)),
            "b": tx.with_suffix(tx.clean(F.col("html"), tx.LATIN, digits=None)),
        },
        {"a": "doc_id", "b": "page_id"},
    )


@query(
    "merged_corpora",
    "E7 C5 D7",
    f"""SELECT 0 AS part, 'a' AS source, doc_id AS ord, {_sql_clean('text')} || ' <|endoftext|>' AS text FROM documents
        UNION ALL SELECT 1, 'b', page_id, {_sql_clean(sql_html('html'))} || ' <|endoftext|>' FROM ({_KEPT_SQL})""",
)
def _(spark, d):
    return _cleaned_corpora(spark, d)


# -- streaming --------------------------------------------------------------------


@query("stream_cleaned_documents", "L1", f"SELECT doc_id, source, {_sql_clean('text')} || ' <|endoftext|>' AS text FROM documents")
def _(spark, d):
    schema = T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint")
    arrivals = read_new_files(spark, d, schema, pattern="documents.parquet")
    out = fresh_path(spark, "stream-out")

    def clean(df):
        text = tx.with_suffix(tx.clean(F.col("text"), tx.LATIN, digits=None, markup=False))
        return df.select("doc_id", "source", text.alias("text"))

    append_cleaned(arrivals, clean, out, fresh_path(spark, "stream-checkpoint"))
    return spark.read.parquet(out)
