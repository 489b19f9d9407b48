"""Named queries over the test tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.sources.tables import spread_small

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``covers`` lists the inventory rows it shows."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        SURVEY_IDS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be worked on."""
    key = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}[name]
    return spread_small(table(spark, sf_dir, name), key)


def load_all() -> None:
    from textloom.plans import catalog_corpus, catalog_runs, catalog_text, catalog_tokens  # noqa: F401
