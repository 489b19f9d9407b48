"""Sites of links and the overlap of two corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.names import is_parsable, site_of
from textloom.plans.shared_dir import materialise

SENT_SITES = 2_000_000  # sites whose hashes may go to every task, some 130 MB


def distinct_links(df: DataFrame, link: str = "link") -> DataFrame:
    return df.select(link).distinct()


def distinct_sites(df: DataFrame, link: str = "link", **options) -> DataFrame:
    """One row per site of the parsable links."""
    return df.select(site_of(F.col(link), **options).alias("site")).where("site IS NOT NULL").distinct()


def unparsable_links(df: DataFrame, link: str = "link") -> DataFrame:
    """Links without a site, with the reason."""
    reason = F.when(F.col(link).isNull(), "missing").when(~is_parsable(F.col(link)), "unbalanced brackets in host")
    return df.select(link, reason.alias("reason")).where("reason IS NOT NULL").distinct()


def new_sites(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Sites that the other corpus does not cover."""
    return sites.join(known.select("site").distinct(), "site", "left_anti")


def articles_of_sites(df: DataFrame, sites: DataFrame, link: str = "link", sent: int = SENT_SITES, **options) -> DataFrame:
    """Rows whose link belongs to one of ``sites``, without nulls in any column.

    Up to ``sent`` sites, which are counted, articles are not moved: the 64-bit
    hashes of the sites go to the tasks of the scan, and with them the sites of
    articles that are none of ``sites`` but share a hash with one. Those are
    found among distinct sites, so that no other column of the articles is
    read for it. More sites are joined by a shuffle, where AQE splits a hot one.
    """
    sites = materialise(sites.select(F.col("site").alias("_site")).where("_site IS NOT NULL").distinct(), "sites")
    keyed = df.withColumn("_site", site_of(F.col(link), **options)).dropna(how="any", subset=[*df.columns, "_site"])
    if sites.count() > sent:
        return keyed.join(sites, "_site", "left_semi").select(*df.columns)
    hashes = sites.select(F.xxhash64("_site").alias("_hash"))
    own = df.select(site_of(F.col(link), **options).alias("_site")).where("_site IS NOT NULL").distinct()
    others = own.withColumn("_hash", F.xxhash64("_site")).join(F.broadcast(hashes), "_hash", "left_semi").join(sites, "_site", "left_anti")
    others = materialise(others.select("_site"), "sites-of-equal-hash")
    kept = keyed.withColumn("_hash", F.xxhash64("_site")).join(F.broadcast(hashes), "_hash", "left_semi")
    if others.count():
        kept = kept.join(F.broadcast(others), "_site", "left_anti")  # one in 2**64 pairs of sites
    return kept.select(*df.columns)


def site_audit(read: DataFrame, saved: DataFrame, link: str = "link") -> DataFrame:
    """One row per site: rows read and rows saved."""
    per_site = lambda df, name: df.groupBy(site_of(F.col(link)).alias("site")).agg(F.count("*").alias(name))
    both = per_site(read, "rows_read").join(per_site(saved, "rows_saved"), "site", "left")
    return both.select("site", "rows_read", F.coalesce("rows_saved", F.lit(0)).alias("rows_saved"))


def concat_corpora(parts: dict[str, DataFrame], text: dict[str, Column], order: dict[str, str]) -> DataFrame:
    """Corpora one after the other: ``(part, source, ord, text)``.

    ``part`` numbers the corpora in the given order. Packing treats ``source``
    as its stream, so windows never cross from one corpus into the next.
    """
    out = None
    for i, (name, df) in enumerate(parts.items()):
        rows = df.select(
            F.lit(i).alias("part"), F.lit(name).alias("source"), F.col(order[name]).cast("bigint").alias("ord"),
            text[name].alias("text"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out
