"""Pre-tokenisation, word counts and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import SPACES, split_words
from textloom.plans.shared_dir import materialise

# Words for the byte-pair vocabulary: one punctuation mark, or a run without any.
_MARKS = r"\p{P}!-/:-@\[-`{-~"
WORD_PATTERN = rf"[{_MARKS}]|[^{SPACES}{_MARKS}]+"

# The split pattern of rank-file tokenizers.
SPLIT_PATTERN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)

SPECIALS = ("<|endoftext|>", "<|unk|>")  # fixed values: ids 0 and 1


def words_of(text: Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pattern_pieces(text: Column) -> Column:
    """Contractions, letter runs, up to three digits, marks and whitespace."""
    return words_of(text, SPLIT_PATTERN)


def word_counts(df: DataFrame, text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """How often each word occurs; hot words are summed before the shuffle."""
    return df.select(F.explode(words_of(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def ranked_vocabulary(counts: DataFrame, size: int | None = None, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """``(token, id, is_special)``: specials first, then words by count and name.

    All words are ranked unless ``size`` asks for the most frequent ones only.
    They are written in ranges along their order; each range is numbered by
    itself and shifted by the words of the ranges before it, so what is ordered
    as a whole is one row per range.
    """
    spark = counts.sparkSession
    order = [F.desc("n"), F.asc("word")]
    ranges = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = materialise(ranges.select("word", "n", F.spark_partition_id().alias("_range")), "ranked-words")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_at", inside).join(F.broadcast(before), "_range")
    words = numbered.select(
        F.col("word").alias("token"), (F.col("_before") + F.col("_at") - 1 + len(specials)).cast("int").alias("id"), F.lit(False).alias("is_special")
    )
    if size is not None:
        words = words.where(F.col("id") < size + len(specials))
    head = [(t, i, True) for i, t in enumerate(specials)]
    return spark.createDataFrame(head, "token string, id int, is_special boolean").unionByName(words)


def add_specials(vocab: DataFrame, tokens: list[str], first_id: int) -> DataFrame:
    """Append special tokens with the ids behind the trained ones.

    A token the vocabulary already has is not added again.
    """
    spark = vocab.sparkSession
    extra = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, pos int")
    extra = extra.join(vocab.select("token"), "token", "left_anti")
    ranked = extra.agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("a"))
    rows = ranked.select(F.posexplode("a").alias("i", "t")).select(
        F.col("t.token").alias("token"), (F.col("i") + first_id).cast("int").alias("id"), F.lit(True).alias("is_special")
    )
    return vocab.unionByName(rows)


def word_list(text: Column) -> Column:
    """Words between whitespace: the closed-vocabulary tokenizer's split."""
    return split_words(text)
