"""Registered queries of the subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    anchors, chat_tree, containment, disclosure, divergence, hash_tree, language_mix, merkle, packing, simhash, token_scan, warc, whitening,
)

from textloom.llm.catalog_sql import CHAT_SQL, MERKLE_SQL
from textloom.plans.shared_dir import materialise

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_simhash_balls")
def simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op1_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_mix.fit(language_mix.learning_rows(docs))
    found = language_mix.identify(docs.select("doc_id", "text"), model).drop("text")
    return found.select(
        "doc_id", language_mix.held_out().alias("held_out"), "language.lang_pred", "language.score", F.size("language.languages").alias("n_languages")
    )


@query("op2_disclosure")
def disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), "private", with_text=False)
    base, terms = F.col("private.base"), F.col("private.terms")

    def count_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count_of(kind) for kind in disclosure.KINDS]
    own = disclosure.digest(base)
    spans = F.concat_ws(",", F.when(F.size(base) > 0, own), F.when(F.size(terms) > 0, disclosure.digest(terms)))
    return found.select("doc_id", *counts, F.sha2(own.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


@query("op3_divergence")
def quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = divergence.judge(docs, divergence.learn(docs))
    return found.select("doc_id", "quality.*")


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


SEPARATOR = 49407  # the tokenizer's end of text


@query("op4_separator_scan")
def separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, documents = token_scan.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path(), SEPARATOR)
    found = token_scan.token_counts(written, SEPARATOR)
    return found.join(documents, ["file", "document"]).select("doc_id", "document", "start", "n_tokens", "ended")


@query("op5_warc_index")
def warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, with_payload=False)


@query("op6_tournament_packing")
def tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@query("op7_fixed_block_anchors")
def fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = anchors.without_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_prefix_filter")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = containment.contained(docs, _table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select(
        "doc_id",
        "containment.n_words",
        "containment.n_hit",
        "containment.n_items",
        F.sha2(F.array_join("containment.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("containment.n_hit") > 0).alias("contaminated"),
    )


SHARDS = 8


@query("op10_hash_tree")
def hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hash_tree.even_tree(SHARDS)
    placed = hash_tree.place(_table(spark, sf_dir, "documents"), tree, next_tree=hash_tree.grown(tree, SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op11_bidiagonal_whitening")
def bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(whitening.usable(_table(spark, sf_dir, "embeddings")).select("vec_id", "x"), "quantised")
    return whitening.whiten(rows, whitening.fit(rows))


@query("op12_merkle_log", sql=MERKLE_SQL)
def merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), changed=changed)
    hex_of = lambda c: F.lower(F.hex(c))
    found = found.withColumn("folded", merkle.folded(F.col("other"), F.col("path")))
    return found.select(
        "doc_id", *[hex_of(c).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        hex_of("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), "log_position",
    )


CHAT_TOKENIZER, CHAT_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op13_chat_prefix_tree", sql=CHAT_SQL)
def chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    kind = "conv_id bigint, turn bigint, role string, text string"
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], kind)
    files = public_tokenizers.path(CHAT_TOKENIZER), public_tokenizers.path(CHAT_RANKS)
    packed, ends = chat_tree.pack_tree(_table(spark, sf_dir, "conversations").select(*columns).unionByName(own), *files)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = chat_tree.read_back(packed, *files).select(
        "node", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return ends.join(materialise(digests, "read-back"), "node").drop("node")
