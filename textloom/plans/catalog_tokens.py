"""Queries over tokenizers, windows, splits, batches and chat sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.hashing import hash60
from textloom.operators import bpe, chat, loader, pack, split, words
from textloom.operators import encode as enc
from textloom.plans import grouped
from textloom.plans.catalog_text import LATIN, sql_collapse, sql_html, sql_keep_script, sql_standardise, sql_strip
from textloom.plans.registry import query, table, text_table
from textloom.plans.shared_dir import fresh_path, materialise
from textloom.sinks import writers
from textloom.sources.legacy_windows import parse_legacy, to_legacy

L, S = 32, 24  # window and stride of the registered queries
VOCABULARY, LEAST = 400, 10  # tokens of the byte-pair queries, and the least frequency of a merge
BATCH = 16


def joined(col) -> Column:
    return F.array_join(F.col(col).cast("array<string>") if isinstance(col, str) else col.cast("array<string>"), ",")


# -- closed-vocabulary tokens and windows -----------------------------------------

_CLEAN_SQL = sql_collapse(sql_keep_script(sql_standardise("text"), LATIN))
_TOKENS_SQL = f"""WITH cleaned AS (SELECT doc_id, source, {_CLEAN_SQL} || ' <|endoftext|>' AS text FROM documents),
  w AS (SELECT doc_id, source, unnest(a) AS token, generate_subscripts(a, 1) AS i
        FROM (SELECT doc_id, source, regexp_extract_all(text, '[^{tx.SPACES}]+') AS a FROM cleaned)),
  v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id
        FROM (SELECT token, count(*) AS n FROM w WHERE token <> '<|endoftext|>' GROUP BY token)
        UNION ALL SELECT '<|endoftext|>', 0),
  k AS (SELECT doc_id, source, list(coalesce(id, 1) ORDER BY i) AS ids FROM w LEFT JOIN v USING (token) GROUP BY doc_id, source),
  t AS (SELECT source, flatten(list(ids ORDER BY doc_id)) AS ids FROM k GROUP BY source)"""
_WINDOWS_SQL = f"""{_TOKENS_SQL},
  win AS (SELECT source, CAST(st // {S} AS BIGINT) AS win, CAST(len(ids) AS BIGINT) AS n_tokens,
            ids[st + 1:st + {L}] AS input_ids, ids[st + 2:st + {L} + 1] AS target_ids
          FROM (SELECT source, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM t)),
  num AS (SELECT *, row_number() OVER (ORDER BY source, win) - 1 AS rn, count(*) OVER () AS n_rows FROM win)"""


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned corpus, written once: vocabulary and encoding both read it."""
    text = tx.with_suffix(tx.clean(F.col("text"), tx.LATIN, digits=None, markup=False))
    return materialise(text_table(spark, d, "documents").select("doc_id", "source", text.alias("text")), "cleaned")


def _closed_vocabulary(cleaned: DataFrame) -> DataFrame:
    counts = cleaned.select(F.explode(words.word_list(F.col("text"))).alias("word")).where(F.col("word") != tx.END_OF_TEXT)
    return words.ranked_vocabulary(counts.groupBy("word").agg(F.count("*").alias("n")))


def _coded(df: DataFrame, key: list[str], vocab: DataFrame, **options) -> DataFrame:
    """``(key.., ids)``; the words stand where the ids will, so a look-up carries no text along."""
    return enc.encode_words(df.select(*key, words.word_list(F.col("text")).alias("ids")), F.col("ids"), vocab, key, **options)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, source, ids, n_ids)``, written once: packing reads it again to count."""
    cleaned = _cleaned(spark, d)
    encoded = _coded(cleaned, ["doc_id", "source"], _closed_vocabulary(cleaned))
    return materialise(pack.with_sizes(encoded), "tokens")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(_tokens(spark, d), ["source"], "doc_id", max_length=L, stride=S, n_ids="n_ids")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return _numbered_windows(_tokens(spark, d))


def _numbered_windows(tokens: DataFrame) -> DataFrame:
    return pack.pack(tokens, ["source"], "doc_id", max_length=L, stride=S, n_ids="n_ids", numbered=True)


def _window_count(spark: SparkSession, d: str) -> DataFrame:
    return pack.count_windows(_tokens(spark, d), ["source"], "n_ids", L, S)


@query("closed_vocabulary", "F3 F12", f"{_TOKENS_SQL} SELECT token, CAST(id AS INTEGER) AS id FROM v UNION ALL SELECT '<|unk|>', 1")
def _(spark, d):
    return _closed_vocabulary(_cleaned(spark, d)).select("token", "id")


@query("closed_vocabulary_ids", "F12 F7", f"{_TOKENS_SQL} SELECT doc_id, array_to_string(ids, ',') AS ids FROM k")
def _(spark, d):
    cleaned = _cleaned(spark, d)
    out = _coded(cleaned, ["doc_id"], _closed_vocabulary(cleaned))
    return out.select("doc_id", joined("ids").alias("ids"))


@query("closed_vocabulary_ids_joined", "F12 F7", f"{_TOKENS_SQL} SELECT doc_id, array_to_string(ids, ',') AS ids FROM k")
def _(spark, d):
    cleaned = _cleaned(spark, d)
    out = _coded(cleaned, ["doc_id"], _closed_vocabulary(cleaned), limit=0)
    return out.select("doc_id", joined("ids").alias("ids"))


@query(
    "closed_vocabulary_decoded",
    "F12 F8",
    f"""{_TOKENS_SQL} SELECT doc_id, string_agg(CASE WHEN v.id IS NULL THEN '<|unk|>' ELSE token END, ' ' ORDER BY i) AS text
        FROM w LEFT JOIN v USING (token) GROUP BY doc_id""",
)
def _(spark, d):
    cleaned = _cleaned(spark, d)
    vocab = _closed_vocabulary(cleaned)
    out = _coded(cleaned, ["doc_id"], vocab)
    return enc.decode(out, F.col("ids"), vocab, ["doc_id"], word_end=None).select("doc_id", "text")


@query(
    "stream_offsets",
    "G1",
    f"""{_TOKENS_SQL} SELECT doc_id, source,
        CAST(coalesce(sum(len(ids)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        CAST(sum(len(ids)) OVER (PARTITION BY source) AS BIGINT) AS n_tokens FROM k""",
)
def _(spark, d):
    return pack.stream_offsets(_tokens(spark, d), ["source"], "doc_id", n_ids="n_ids").select("doc_id", "source", "start", "n_tokens")


_WIN_COLS = "array_to_string(input_ids, ',') AS input_ids, array_to_string(target_ids, ',') AS target_ids"


def _shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, joined("input_ids").alias("input_ids"), joined("target_ids").alias("target_ids"))


@query("packed_windows", "G1 G2 G3", f"{_WINDOWS_SQL} SELECT source, win, n_tokens, {_WIN_COLS} FROM win")
def _(spark, d):
    return _shown(_windows(spark, d), "source", "win", "n_tokens")


@query(
    "packed_windows_by_digest",
    "G1 G2 H7",
    f"""{_TOKENS_SQL},
  td AS (SELECT source, flatten(list(ids ORDER BY md5(CAST(doc_id AS VARCHAR)))) AS ids FROM k GROUP BY source)
  SELECT source, CAST(st // {S} AS BIGINT) AS win, CAST(len(ids) AS BIGINT) AS n_tokens,
    row_number() OVER (ORDER BY source, st) - 1 AS rn, {", ".join(f"array_to_string(ids[st + {a + 1}:st + {L + a}], ',') AS {c}" for a, c in enumerate(("input_ids", "target_ids")))}
  FROM (SELECT source, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM td)""",
)
def _(spark, d):
    """Documents follow one another in the order of a digest, not of their ids."""
    tokens = _tokens(spark, d).withColumn("digest", F.md5(F.col("doc_id").cast("string").cast("binary")))
    windows = pack.pack(tokens, ["source"], "digest", max_length=L, stride=S, n_ids="n_ids", any_key=True, numbered=True)
    return _shown(windows, "source", "win", "n_tokens", "rn")


@query(
    "windows_per_document",
    "G3 G4",
    f"""{_TOKENS_SQL} SELECT doc_id, CAST(st // {S} AS BIGINT) AS win,
          array_to_string(ids[st + 1:st + {L}], ',') AS input_ids, array_to_string(ids[st + 2:st + {L} + 1], ',') AS target_ids
        FROM (SELECT doc_id, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM k)""",
)
def _(spark, d):
    return _shown(pack.pack_rows(_tokens(spark, d), ["doc_id"], max_length=L, stride=S), "doc_id", "win")


@query("window_counts", "G5", f"{_WINDOWS_SQL} SELECT t.source, CAST(count(win.win) AS BIGINT) AS n FROM t LEFT JOIN win USING (source) GROUP BY t.source")
def _(spark, d):
    streams = _tokens(spark, d).groupBy("source").agg(F.sum("n_ids").alias("n_tokens"))
    return streams.select("source", pack.n_windows(F.col("n_tokens"), L, S).alias("n"))


@query("window_by_index", "G5", f"{_WINDOWS_SQL} SELECT source, win, {_WIN_COLS} FROM win WHERE win = 3")
def _(spark, d):
    return _shown(pack.window_at(_windows(spark, d), 3), "source", "win")


@query("capped_text", "G6", "SELECT doc_id, substr(text, 1, 500) AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", pack.cap_text(F.col("text"), 500).alias("text"))


@query("legacy_windows", "A8", f"{_WINDOWS_SQL} SELECT source, win, {_WIN_COLS} FROM win")
def _(spark, d):
    return _shown(parse_legacy(to_legacy(_windows(spark, d).drop("n_tokens"))), "source", "win")


# -- splits and batches ------------------------------------------------------------

_CUT = "CAST(floor(n_rows * 0.9::DOUBLE) AS BIGINT)"


@query("split_sizes", "H1 J1", f"{_WINDOWS_SQL} SELECT count(*) AS n_rows, CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) AS n_train FROM win")
def _(spark, d):
    return _window_count(spark, d).select("n_rows", split.head_size(F.col("n_rows")).alias("n_train"))


@query(
    "positional_split",
    "H2 H3",
    f"{_WINDOWS_SQL} SELECT source, win, rn, CASE WHEN rn < {_CUT} THEN 'train' ELSE 'test' END AS split FROM num",
)
def _(spark, d):
    return split.positional_split(_numbered(spark, d)).select("source", "win", "rn", "split")


@query(
    "windows_per_source_and_split",
    "G2 H2 H3 J1",
    f"""{_WINDOWS_SQL} SELECT source, CASE WHEN rn < {_CUT} THEN 'train' ELSE 'test' END AS split,
        count(*) AS n_windows, CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens,
        CAST(sum(list_sum(input_ids)) AS BIGINT) AS input_sum, CAST(sum(list_sum(target_ids)) AS BIGINT) AS target_sum
        FROM num GROUP BY ALL""",
)
def windows_per_source_and_split(spark, d):
    """Raw text, cleaned, encoded, packed, numbered and split."""
    return _per_split(_numbered(spark, d))


def _per_split(numbered: DataFrame) -> DataFrame:
    rows = split.positional_split(numbered)

    def total(c):
        return F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))

    return rows.groupBy("source", "split").agg(
        F.count("*").alias("n_windows"), F.sum(F.size("input_ids")).alias("n_tokens"),
        total("input_ids").alias("input_sum"), total("target_ids").alias("target_sum"),
    )


@query(
    "split_reconciliation",
    "H4",
    f"""{_WINDOWS_SQL} SELECT CAST(count(*) FILTER (WHERE rn < {_CUT}) AS BIGINT) AS n_train,
        CAST(count(*) FILTER (WHERE rn >= {_CUT}) AS BIGINT) AS n_test, count(*) AS n_total, true AS agrees FROM num""",
)
def _(spark, d):
    windows = materialise(_numbered(spark, d), "windows")
    return split.reconcile(split.positional_split(windows), windows)


@query(
    "written_splits",
    "B4 A7 H2 H3",
    f"""{_WINDOWS_SQL} SELECT CASE WHEN rn < {_CUT} THEN 'train' ELSE 'test' END AS split, count(*) AS n,
        min(rn) AS first_row, max(rn) AS last_row FROM num GROUP BY ALL""",
)
def _(spark, d):
    path = fresh_path(spark, "split-windows")
    writers.write_splits(split.positional_split(_numbered(spark, d)).select("rn", "split", "input_ids", "target_ids"), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n"), F.min("rn").alias("first_row"), F.max("rn").alias("last_row")
    )


def sql_hash60(*cols: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(cols)}, '{seed}')), 1, 15)) AS BIGINT)"


@query(
    "hash_split",
    "H5",
    f"""SELECT doc_id, CASE WHEN {sql_hash60('doc_id', 'source')} % 1000000 < 900000 THEN 'train' ELSE 'test' END AS split
        FROM documents""",
)
def _(spark, d):
    return split.hash_split(table(spark, d, "documents"), ["doc_id", "source"]).select("doc_id", "split")


@query("shuffled_positions", "H7", f"SELECT doc_id, row_number() OVER (ORDER BY {sql_hash60('doc_id')}, doc_id) - 1 AS rn FROM documents")
def _(spark, d):
    return split.shuffled_numbers(table(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", "rn")


@query(
    "positions_by_hashed_key",
    "H1 H7 J3",
    f"""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS n
        FROM (SELECT source, doc_id, {sql_hash60('doc_id')} * 8 - {1 << 62} AS h FROM documents)""",
)
def _(spark, d):
    """Rows numbered in their source along a signed 64-bit hash."""
    keyed = table(spark, d, "documents").select("source", "doc_id", (hash60("doc_id") * 8 - F.lit(1 << 62)).alias("h"))
    return grouped.positions(keyed, ["source"], ["h", "doc_id"], "rn", "n").drop("h")


@query(
    "split_texts",
    "H6",
    """SELECT doc_id, substr(text, 1, CAST(floor(length(text) * 0.9::DOUBLE) AS INTEGER)) AS train_text,
       substr(text, CAST(floor(length(text) * 0.9::DOUBLE) AS INTEGER) + 1) AS test_text FROM documents""",
)
def _(spark, d):
    return split.split_text(table(spark, d, "documents")).select("doc_id", "train_text", "test_text")


def _documents_numbered(spark, d):
    return split.number_rows(table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    "batch_ids",
    "H8",
    f"""SELECT doc_id, rn, rn // {BATCH} AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn,
        count(*) OVER () AS n FROM documents) WHERE rn // {BATCH} < n // {BATCH}""",
)
def _(spark, d):
    return split.batches(_documents_numbered(spark, d), BATCH).select("doc_id", "rn", "batch_id")


@query(
    "batch_ids_with_last",
    "H8",
    f"SELECT doc_id, rn, rn // {BATCH} AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)",
)
def _(spark, d):
    return split.batches(_documents_numbered(spark, d), BATCH, drop_last=False).select("doc_id", "rn", "batch_id")


@query(
    "collated_batches",
    "H8 H9",
    f"""{_WINDOWS_SQL} SELECT rn // {BATCH} AS batch_id, count(*) AS n_rows,
        array_to_string(flatten(list(input_ids ORDER BY rn)), ',') AS input_ids,
        array_to_string(flatten(list(target_ids ORDER BY rn)), ',') AS target_ids
        FROM num WHERE rn // {BATCH} < n_rows // {BATCH} GROUP BY rn // {BATCH}""",
)
def _(spark, d):
    stacked = split.collate(split.batches(_numbered(spark, d), BATCH))
    return stacked.select(
        "batch_id", F.size("input_ids").cast("bigint").alias("n_rows"), joined(F.flatten("input_ids")).alias("input_ids"),
        joined(F.flatten("target_ids")).alias("target_ids"),
    )


@query("loader_length", "H10", f"{_WINDOWS_SQL} SELECT count(*) // {BATCH} AS n_batches FROM win")
def _(spark, d):
    return _window_count(spark, d).select(split.n_batches(F.col("n_rows"), BATCH).alias("n_batches"))


@query(
    "resumed_batches",
    "H11",
    f"""SELECT doc_id, rn // {BATCH} AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn,
        count(*) OVER () AS n FROM documents) WHERE rn // {BATCH} < n // {BATCH} AND rn // {BATCH} >= 100 % 12""",
)
def _(spark, d):
    return split.resume(split.batches(_documents_numbered(spark, d), BATCH), 100, 12).select("doc_id", "batch_id")


@query(
    "epochs_of_batches",
    "H12",
    f"""SELECT doc_id, epoch, epoch * (n // {BATCH}) + rn // {BATCH} AS step FROM (SELECT doc_id,
        row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents), (SELECT unnest([0, 1, 2]) AS epoch)
        WHERE rn // {BATCH} < n // {BATCH}""",
)
def _(spark, d):
    rows = split.batches(_documents_numbered(spark, d), BATCH)
    return split.repeat_epochs(rows, 3, split.n_batches(F.col("n_rows"), BATCH)).select("doc_id", "epoch", "step")


_HALVES_SQL = f"""{_TOKENS_SQL},
  h AS (SELECT doc_id, split, text FROM (
      SELECT doc_id, 'train' AS split, substr(text, 1, CAST(floor(length(text) * 0.9::DOUBLE) AS INTEGER)) AS text FROM cleaned
      UNION ALL SELECT doc_id, 'validation', substr(text, CAST(floor(length(text) * 0.9::DOUBLE) AS INTEGER) + 1) FROM cleaned)),
  hw AS (SELECT doc_id, split, unnest(a) AS token, generate_subscripts(a, 1) AS i
         FROM (SELECT doc_id, split, regexp_extract_all(text, '[^{tx.SPACES}]+') AS a FROM h)),
  hk AS (SELECT doc_id, split, list(coalesce(id, 1) ORDER BY i) AS ids FROM hw LEFT JOIN v USING (token) GROUP BY doc_id, split),
  hn AS (SELECT doc_id, split, st // {S} AS win, ids[st + 1:st + {L}] AS input_ids, ids[st + 2:st + {L} + 1] AS target_ids
         FROM (SELECT doc_id, split, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM hk)),
  o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id, win) - 1 AS p, count(*) OVER (PARTITION BY split) AS n FROM hn),
  b AS (SELECT *, (CASE WHEN split = 'train' THEN row_number() OVER (PARTITION BY split ORDER BY {sql_hash60('p')}, p) - 1 ELSE p END) AS rn FROM o)"""


@query(
    "text_loader_batches",
    "H6 H7 H8 G4 G5",
    f"""{_HALVES_SQL} SELECT split, doc_id, CAST(win AS BIGINT) AS win, rn // {BATCH} AS batch_id, {_WIN_COLS} FROM b
        WHERE split = 'validation' OR rn // {BATCH} < n // {BATCH}""",
)
def _(spark, d):
    cleaned = _cleaned(spark, d)
    vocab = _closed_vocabulary(cleaned)

    def encode(df):
        return _coded(df, ["doc_id"], vocab)

    rows = loader.text_batches(cleaned, encode, "doc_id", batch_size=BATCH, max_length=L, stride=S)
    return _shown(rows, "split", "doc_id", "win", "batch_id")


# -- byte-pair vocabulary -------------------------------------------------------------

_PATTERN_SQL = words.WORD_PATTERN.replace("'", "''")


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{_PATTERN_SQL}')"


_SYMS = "string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1))"


def sql_training(texts: str, tokens: int = VOCABULARY, more_words: str = "SELECT NULL WHERE false") -> str:
    """Merges one at a time until there are ``tokens`` or none is frequent; ``more_words`` are split along without being counted."""
    return f"""WITH RECURSIVE wc AS (
      SELECT word, sum(n) AS n FROM (
        SELECT unnest({sql_words('text')}) AS word, 1 AS n FROM ({texts})
        UNION ALL SELECT word, 0 FROM ({more_words}) AS m(word)) GROUP BY word),
    boxed AS (SELECT word, n, regexp_replace(word, '(?s)(.)', chr(1) || '\\1' || chr(2), 'g') AS b FROM wc),
    alphabet AS (SELECT DISTINCT unnest(string_split(substr(e, 2, length(e) - 2), chr(2) || chr(1))) AS token
      FROM (SELECT substr(b, 1, length(b) - 1) || '</w>' || chr(2) AS e FROM boxed WHERE n > 0)),
    st AS (
      SELECT 0 AS step, word, n, substr(b, 1, length(b) - 1) || '</w>' || chr(2) AS s,
             '' AS l, '' AS r, CAST(0 AS HUGEINT) AS c FROM boxed
      UNION ALL
      SELECT st.step + 1, st.word, st.n,
             replace(st.s, chr(1) || p.l || chr(2) || chr(1) || p.r || chr(2), chr(1) || p.l || p.r || chr(2)), p.l, p.r, p.c
      FROM st, (SELECT a[i] AS l, a[i + 1] AS r, CAST(sum(n) AS HUGEINT) AS c
                FROM (SELECT n, a, unnest(range(1, len(a))) AS i FROM (SELECT n, {_SYMS} AS a FROM st))
                GROUP BY 1, 2 ORDER BY c DESC, l, r LIMIT 1) AS p
      WHERE st.step < {tokens} - 2 - (SELECT count(*) FROM alphabet) AND p.c >= {LEAST}),
    merges AS (SELECT DISTINCT step - 1 AS rank, l AS "left", r AS "right", l || r AS merged, CAST(c AS BIGINT) AS n FROM st WHERE step > 0),
    vocab AS (
      SELECT '<|endoftext|>' AS token, 0 AS id, true AS is_special UNION ALL SELECT '<|unk|>', 1, true UNION ALL
      SELECT token, CAST(row_number() OVER (ORDER BY part, rank, token) + 1 AS INTEGER), false FROM (
        SELECT token, 0 AS part, 0 AS rank FROM alphabet UNION ALL
        SELECT merged, 1, min(rank) FROM merges WHERE merged NOT IN (SELECT token FROM alphabet) GROUP BY merged)),
    lexicon AS (
      SELECT word, list(coalesce(id, 1) ORDER BY j) AS ids, list(piece ORDER BY j) AS pieces FROM (
        SELECT word, unnest(a) AS piece, generate_subscripts(a, 1) AS j
        FROM (SELECT word, {_SYMS} AS a FROM st WHERE step = (SELECT max(step) FROM st))) LEFT JOIN vocab ON piece = token GROUP BY word)"""


def sql_encoded(key: str, source: str, text: str) -> str:
    """``key, ids`` over the lexicon."""
    return f"""SELECT {key}, flatten(list(ids ORDER BY i)) AS ids FROM (
        SELECT {key}, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM (SELECT {key}, {sql_words(text)} AS a FROM {source}))
        JOIN lexicon USING (word) GROUP BY {key}"""


_TRAIN_SQL = sql_training("SELECT text FROM documents")


def _model(spark, d):
    return bpe.train_on_text(text_table(spark, d, "documents"), vocab_size=VOCABULARY, min_frequency=LEAST)


@query("word_counts", "F1", f"SELECT word, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS word FROM documents) GROUP BY word")
def _(spark, d):
    return words.word_counts(text_table(spark, d, "documents"))


@query(
    "pair_counts",
    "F2",
    f"""{sql_training("SELECT text FROM documents", 0)} SELECT a[i] AS "left", a[i + 1] AS "right", CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT n, a, unnest(range(1, len(a))) AS i FROM (SELECT n, {_SYMS} AS a FROM st)) GROUP BY 1, 2""",
)
def _(spark, d):
    return bpe.pair_counts(bpe.symbol_words(words.word_counts(text_table(spark, d, "documents"))))


@query("learnt_merges", "F2", f'{_TRAIN_SQL} SELECT CAST(rank AS INTEGER) AS rank, "left", "right", merged, n FROM merges')
def _(spark, d):
    return _model(spark, d)[1]


@query(
    "merges_of_cleaned_rows",
    "F4",
    f"""{sql_training(f"SELECT {sql_collapse(sql_keep_script(sql_standardise(sql_html('html')), LATIN))} AS text FROM pages")}
        SELECT CAST(rank AS INTEGER) AS rank, "left", "right", merged, n FROM merges""",
)
def _(spark, d):
    rows = text_table(spark, d, "pages").select(tx.clean(F.col("html"), tx.LATIN, digits=None).alias("text"))
    return bpe.train_on_text(rows, vocab_size=VOCABULARY, min_frequency=LEAST)[1]


@query("trained_vocabulary", "F3 F10", f"{_TRAIN_SQL} SELECT token, id, is_special FROM vocab")
def _(spark, d):
    return _model(spark, d)[0]


@query("vocabulary_size", "F10", f"{_TRAIN_SQL} SELECT count(*) AS n, max(id) AS last_id FROM vocab")
def _(spark, d):
    return _model(spark, d)[0].agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


_SPECIALS_SQL = "UNION ALL ".join(
    f"SELECT '{t}' AS token, (SELECT CAST(max(id) AS INTEGER) FROM vocab) + {i + 1} AS id, true AS is_special " for i, t in enumerate(chat.CHAT_SPECIALS)
)


@query("vocabulary_with_specials", "F5 B5", f"{_TRAIN_SQL} SELECT token, id, is_special FROM vocab UNION ALL {_SPECIALS_SQL}")
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    path = fresh_path(spark, "tokenizer")
    writers.save_tokenizer(words.add_specials(vocab, chat.CHAT_SPECIALS, vocab.count()), merges, path)
    return writers.load_tokenizer(spark, path)[0]


@query(
    "split_words",
    "F6 F9",
    f"{_TRAIN_SQL} SELECT word, array_to_string(pieces, ' ') AS pieces FROM lexicon",
)
def _(spark, d):
    counts = words.word_counts(text_table(spark, d, "documents"))
    _, merges, _ = bpe.train(counts, vocab_size=VOCABULARY, min_frequency=LEAST)
    return enc.word_lexicon(counts, merges).select("word", F.array_join("pieces", " ").alias("pieces"))


@query(
    "encoded_documents",
    "F6",
    f"{_TRAIN_SQL} SELECT doc_id, '0,' || array_to_string(ids, ',') || ',0' AS ids FROM ({sql_encoded('doc_id', 'documents', 'text')})",
)
def _(spark, d):
    docs = text_table(spark, d, "documents")
    vocab, merges, _ = _model(spark, d)
    out = enc.encode(docs, words.words_of(F.col("text")), merges, vocab, bos=0, eos=0)
    return out.select("doc_id", joined("ids").alias("ids"))


_MARKED_IDS_SQL = f"""{_TRAIN_SQL},
  bk AS (SELECT d.doc_id, d.source, list_append(coalesce(e.ids, []), 0) AS ids
         FROM documents d LEFT JOIN ({sql_encoded('doc_id', 'documents', 'text')}) e ON e.doc_id = d.doc_id),
  bt AS (SELECT source, flatten(list(ids ORDER BY doc_id)) AS ids FROM bk GROUP BY source)"""


@query(
    "bpe_packed_windows",
    "F6 G1 G2 G3",
    f"""{_MARKED_IDS_SQL} SELECT source, CAST(st // {S} AS BIGINT) AS win, CAST(len(ids) AS BIGINT) AS n_tokens,
        array_to_string(ids[st + 1:st + {L}], ',') AS input_ids, array_to_string(ids[st + 2:st + {L} + 1], ',') AS target_ids
        FROM (SELECT source, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM bt)""",
)
def _(spark, d):
    return _shown(pack.pack(_bpe_tokens(spark, d), ["source"], "doc_id", max_length=L, stride=S, n_ids="n_ids"), "source", "win", "n_tokens")


def _bpe_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = text_table(spark, d, "documents")
    vocab, merges, _ = _model(spark, d)
    marked = docs.select("doc_id", "source", tx.with_suffix(F.coalesce("text", F.lit(""))).alias("text"))
    split_up = enc.words_with_specials(F.col("text"), [tx.END_OF_TEXT], words.WORD_PATTERN)
    ids = enc.encode(marked, split_up, merges, vocab).select("doc_id", "source", "ids")
    return materialise(pack.with_sizes(ids), "bpe-tokens")


@query(
    "bpe_windows_per_source_and_split",
    "F2 F6 G2 H2 H3 J1",
    f"""{_MARKED_IDS_SQL},
      win AS (SELECT source, CAST(st // {S} AS BIGINT) AS win, ids[st + 1:st + {L}] AS input_ids, ids[st + 2:st + {L} + 1] AS target_ids
              FROM (SELECT source, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM bt)),
      num AS (SELECT *, row_number() OVER (ORDER BY source, win) - 1 AS rn, count(*) OVER () AS n_rows FROM win)
      SELECT source, CASE WHEN rn < {_CUT} THEN 'train' ELSE 'test' END AS split, count(*) AS n_windows,
        CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens, CAST(sum(list_sum(input_ids)) AS BIGINT) AS input_sum,
        CAST(sum(list_sum(target_ids)) AS BIGINT) AS target_sum FROM num GROUP BY ALL""",
)
def bpe_windows_per_source_and_split(spark, d):
    """The flagship: raw text, a trained vocabulary, ids with end marks, windows, numbers, splits."""
    return _per_split(_numbered_windows(_bpe_tokens(spark, d)))


_ITEM_WORDS = f"SELECT unnest({sql_words('text')}) FROM benchmark"


@query(
    "encoded_second_corpus",
    "F6 F7 F13",
    f"""{sql_training("SELECT text FROM documents", VOCABULARY, _ITEM_WORDS)} SELECT item_id, array_to_string(ids, ',') AS ids
        FROM ({sql_encoded('item_id', 'benchmark', 'text')})""",
)
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    out = enc.encode(table(spark, d, "benchmark"), words.words_of(F.col("text")), merges, vocab)
    return out.select("item_id", joined("ids").alias("ids"))


@query("decoded_documents", "F8 F13 I4", f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS text FROM documents")
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    docs = text_table(spark, d, "documents").select("doc_id", "text")
    coded = enc.encode(docs, words.words_of(F.col("text")), merges, vocab).select("doc_id", "ids")
    return enc.decode(coded, F.col("ids"), vocab, ["doc_id"]).select("doc_id", "text")


@query(
    "token_pieces",
    "F9",
    f"""{sql_training("SELECT text FROM documents", VOCABULARY, _ITEM_WORDS)}
        SELECT item_id, CAST(pos AS INTEGER) AS pos, e.id, replace(token, '</w>', '') AS piece FROM (
          SELECT item_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM ({sql_encoded('item_id', 'benchmark', 'text')})) e
        JOIN vocab ON vocab.id = e.id""",
)
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    out = enc.encode(table(spark, d, "benchmark"), words.words_of(F.col("text")), merges, vocab)
    return enc.pieces_of(out, F.col("ids"), vocab, ["item_id"])


# RE2 has no lookahead: mark the last space of a run before a word instead, then split there.
_MARKED = "regexp_replace(text, '(\\s+)([^\\S\\r\\n]\\S)', '\\1' || chr(57345) || '\\2', 'g')"
_PIECES_SQL = (
    "(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\\r\\n\\p{L}\\p{N}\\x{e001}]?\\p{L}+|\\p{N}{1,3}"
    "| ?[^\\s\\p{L}\\p{N}\\x{e001}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+|\\x{e001}"
)


@query(
    "pattern_pieces",
    "F11",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all({_MARKED}, '{_PIECES_SQL}'), lambda x: x <> chr(57345)), '|') AS pieces
        FROM documents""",
)
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", F.array_join(words.pattern_pieces(F.col("text")), "|").alias("pieces"))


# -- chat ----------------------------------------------------------------------------

_HEADER_SQL = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)"
_TURN_SQL = f"{_HEADER_SQL} || {sql_strip('text')} || '<|eot_id|>'"


@query("chat_headers", "I1", f"SELECT conv_id, turn, {_HEADER_SQL} AS text FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", chat.header_text(F.col("role")).alias("text"))


@query("chat_turns", "I2", f"SELECT conv_id, turn, {_TURN_SQL} AS text FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", chat.turn_text(F.col("text"), F.col("role")).alias("text"))


@query(
    "chat_conversations",
    "I3",
    f"""SELECT conv_id, CAST(turn // {chat.TURNS_PER_PART} AS BIGINT) AS part, count(*) AS n_turns,
        string_agg({_TURN_SQL}, '' ORDER BY turn) AS text FROM conversations GROUP BY ALL""",
)
def _(spark, d):
    return chat.render_conversations(table(spark, d, "conversations"))


@query(
    "chat_placed_turns",
    "I2 I3",
    f"""WITH said AS (SELECT conv_id, turn, {_TURN_SQL} AS text FROM conversations)
        SELECT conv_id, turn, text, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS n_chars,
        CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM said""",
)
def _(spark, d):
    return chat.placed_turns(table(spark, d, "conversations"))


_CHAT_IDS_SQL = f"""{sql_training("SELECT text FROM documents", VOCABULARY, f"SELECT unnest({sql_words('text')}) FROM conversations UNION ALL SELECT unnest({sql_words('role')}) FROM conversations")},
      n AS (SELECT count(*) AS n FROM vocab),
      said AS ({sql_encoded('conv_id, turn', 'conversations', 'text')}),
      roles AS ({sql_encoded('conv_id, turn', 'conversations', 'role')}),
      coded AS (SELECT conv_id, turn, concat_ws(',', n + 2, array_to_string(roles.ids, ','), n + 3, n + 5, array_to_string(said.ids, ','), n + 4) AS ids
      FROM roles LEFT JOIN said USING (conv_id, turn), n)"""


@query(
    "chat_turn_ids",
    "I1 I2 F13",
    f"{_CHAT_IDS_SQL} SELECT conv_id, turn, ids FROM coded",
)
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    n = vocab.count()
    special = {t: n + i for i, t in enumerate(chat.CHAT_SPECIALS)}
    turns = chat.encode_turns(text_table(spark, d, "conversations"), merges, vocab, special)
    return turns.select("conv_id", "turn", joined("ids").alias("ids"))


@query(
    "chat_windows",
    "I3 G1 G2",
    f"""{_CHAT_IDS_SQL},
      whole AS (SELECT conv_id, string_split(string_agg(ids, ',' ORDER BY turn), ',') AS ids FROM coded GROUP BY conv_id)
      SELECT conv_id, CAST(st // {S} AS BIGINT) AS win, CAST(len(ids) AS BIGINT) AS n_tokens,
        array_to_string(ids[st + 1:st + {L}], ',') AS input_ids, array_to_string(ids[st + 2:st + {L} + 1], ',') AS target_ids
      FROM (SELECT conv_id, ids, unnest(range(0, greatest(len(ids) - {L}, 0), {S})) AS st FROM whole)""",
)
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    n = vocab.count()
    special = {t: n + i for i, t in enumerate(chat.CHAT_SPECIALS)}
    turns = chat.encode_turns(text_table(spark, d, "conversations"), merges, vocab, special).select("conv_id", "turn", "ids")
    windows = chat.conversation_windows(materialise(turns, "chat-ids"), max_length=L, stride=S)
    return _shown(windows, "conv_id", "win", "n_tokens")


_CHAT_TOKENS_SQL = "UNION ALL ".join(f"SELECT '{t}' AS token, {i} + (SELECT n FROM n) AS id " for i, t in enumerate(chat.CHAT_SPECIALS))


@query(
    "chat_ids_decoded",
    "I4 F8",
    f"""{_CHAT_IDS_SQL},
      tokens AS (SELECT token, id FROM vocab UNION ALL {_CHAT_TOKENS_SQL}),
      placed AS (SELECT conv_id, turn, unnest(string_split(ids, ',')) AS id, generate_subscripts(string_split(ids, ','), 1) AS i FROM coded)
      SELECT conv_id, turn, rtrim(replace(string_agg(token, '' ORDER BY i), '</w>', ' ')) AS text
      FROM placed JOIN tokens ON tokens.id = CAST(placed.id AS BIGINT) GROUP BY conv_id, turn""",
)
def _(spark, d):
    vocab, merges, _ = _model(spark, d)
    n = vocab.count()
    special = {t: n + i for i, t in enumerate(chat.CHAT_SPECIALS)}
    turns = chat.encode_turns(text_table(spark, d, "conversations"), merges, vocab, special).select("conv_id", "turn", "ids")
    tokens = words.add_specials(vocab, chat.CHAT_SPECIALS, n)
    return enc.decode(turns, F.col("ids"), tokens, ["conv_id", "turn"]).select("conv_id", "turn", "text")
