"""Queries that clean and test text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.html import decode_entities, html_text
from textloom.operators.chat import turn_text
from textloom.plans.registry import query, table, text_table
from textloom.sources.tables import non_empty

# SQL spellings of the Column forms. RE2 reads the same class bodies.
_SP = tx.SPACES
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
DEVANAGARI = r"\x{0900}-\x{097F}"
_MARKS = r"!-/:-@\[-`{-~"


def _q(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SP}]+|[{_SP}]+\\z', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SP}]+', ' ', 'g'), ' ')"


def sql_standardise(x: str) -> str:
    for key, form in tx.STANDARD_FORMS.items():
        x = f"replace({x}, {_q(key)}, {_q(form)})"
    return x


def sql_digits(x: str) -> str:
    return f"translate({x}, '{tx.ASCII_DIGITS}', '{tx.DEVANAGARI_DIGITS}')"


def sql_keep_script(x: str, script: str) -> str:
    p = _MARKS
    other = f"[^{script} {p}]"
    steps = [
        (rf"(^|{other})[{p}]+\z", r"\1"),
        (rf"[{p}]+([^{script}{p}])", r"\1"),
        (rf"[{p}]*([{p}])([{script}]|\z)", r"\1\2"),
        (rf"^{other}+|{other}+\z", ""),
        (rf"{other}+", " "),
    ]
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return x


def sql_html(x: str) -> str:
    node = "chr(57344)"
    for block in (
        "(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        "(?s)<[!/?a-zA-Z][^>]*>",
    ):
        x = f"regexp_replace({x}, '{block}', {node}, 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        end = ";" if name.startswith("#") else ";?"  # names of old stand without a semicolon too
        x = f"regexp_replace({x}, '&{name}{end}', '{char}', 'g')"
    x = f"regexp_replace({x}, '[{_SP}]*\\x{{e000}}[{_SP}\\x{{e000}}]*', ' ', 'g')"
    return sql_strip(x)


@query("html_to_text", "D1", f"SELECT page_id, {sql_html('html')} AS text FROM pages")
def _(spark, d):
    return text_table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(
    "decode_entities",
    "D1",
    "SELECT doc_id, text FROM documents",
)
def _(spark, d):
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#x27;"))
    return text_table(spark, d, "documents").select("doc_id", decode_entities(escaped).alias("text"))


@query("standardise_characters", "D2", f"SELECT doc_id, {sql_standardise('text')} AS text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.standardise(F.col("text")).alias("text"))


@query("native_digits", "D3", f"SELECT doc_id, {sql_digits('text')} AS text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.native_digits(F.col("text")).alias("text"))


@query("keep_script_latin", "D4", f"SELECT doc_id, {sql_keep_script('text', LATIN)} AS text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.keep_script(F.col("text"), tx.LATIN).alias("text"))


@query("keep_script_devanagari", "D4", f"SELECT doc_id, {sql_keep_script(sql_digits('text'), DEVANAGARI)} AS text FROM documents")
def _(spark, d):
    digits = tx.native_digits(F.col("text"))
    return text_table(spark, d, "documents").select("doc_id", tx.keep_script(digits).alias("text"))


@query(
    "keep_script_only",
    "D5",
    f"SELECT doc_id, regexp_replace(text, '[^{LATIN} ]', ' ', 'g') AS text FROM documents",
)
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.keep_script(F.col("text"), tx.LATIN, punctuation=False).alias("text"))


@query("collapse_spaces", "D6", f"SELECT doc_id, {sql_collapse('text')} AS text FROM documents")
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.collapse_spaces(F.col("text")).alias("text"))


@query(
    "clean_pages",
    "D7 L2",
    f"SELECT page_id, {sql_collapse(sql_keep_script(sql_standardise(sql_html('html')), LATIN))} AS text FROM pages",
)
def _(spark, d):
    return text_table(spark, d, "pages").select("page_id", tx.clean(F.col("html"), tx.LATIN, digits=None).alias("text"))


@query(
    "clean_documents_devanagari",
    "D7",
    f"""SELECT doc_id, {sql_collapse(sql_keep_script(sql_digits(sql_standardise('text')), DEVANAGARI))} AS text
    FROM documents""",
)
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.clean(F.col("text"), markup=False).alias("text"))


@query(
    "drop_punctuation_and_digits",
    "D8",
    f"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(2405), ''),
        '[{_MARKS}0-9\\x{{0966}}-\\x{{096F}}]', '', 'g'), '[{_SP}]+', ' ', 'g') AS text
    FROM documents""",
)
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.drop_punctuation_and_digits(F.col("text")).alias("text"))


@query(
    "cut_between_marks",
    "D9",
    """SELECT doc_id,
       CASE WHEN instr(text, ' the ') = 0 OR instr(text, ' of ') = 0 THEN NULL
            WHEN instr(text, ' of ') <= instr(text, ' the ') THEN ''
            ELSE substr(text, instr(text, ' the '), instr(text, ' of ') - instr(text, ' the ')) END AS text
       FROM documents""",
)
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.cut_between(F.col("text"), " the ", " of ").alias("text"))


_TURN_SQL = f"'<|start_header_id|>' || role || '<|end_header_id|>\n\n' || {sql_strip('text')} || '<|eot_id|>'"


@query(
    "reply_after_header",
    "D10 D11",
    f"""SELECT conv_id, turn,
       replace(CASE WHEN role = 'assistant' THEN {sql_strip(sql_strip('text') + " || '<|eot_id|>'")}
                    ELSE {_TURN_SQL} END, '<|eot_id|>', '') AS text
       FROM conversations""",
)
def _(spark, d):
    said = turn_text(F.col("text"), F.col("role"))
    reply = tx.drop_marker(tx.after_header(said, "assistant<|end_header_id|>\n\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", reply.alias("text"))


@query(
    "cut_at_markers",
    "D12",
    f"""SELECT conv_id, turn, split_part({_TURN_SQL}, '<|eot_id|>', 1) AS text FROM conversations""",
)
def _(spark, d):
    said = tx.with_suffix(turn_text(F.col("text"), F.col("role")))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.cut_at_markers(said).alias("text"))


def _sql_limit(items: str, glue: str, src: str, key: str) -> str:
    return f"""WITH s AS (SELECT {key}, {items} AS a FROM {src}),
      e AS (SELECT {key}, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM s),
      f AS (SELECT *, lag(x, 1) OVER w AS p1, lag(x, 2) OVER w AS p2, lag(x, 3) OVER w AS p3
            FROM e WINDOW w AS (PARTITION BY {key} ORDER BY i)),
      g AS (SELECT {key}, string_agg(x, {glue} ORDER BY i) AS text FROM f
            WHERE NOT coalesce(x = p1 AND x = p2 AND x = p3, false) GROUP BY {key})
      SELECT s.{key}, coalesce(g.text, '') AS text FROM s LEFT JOIN g USING ({key})"""


@query("limit_repeated_lines", "D13", _sql_limit("string_split(text, chr(10))", "chr(10)", "documents", "doc_id"))
def _(spark, d):
    return text_table(spark, d, "documents").select("doc_id", tx.limit_repeated_lines(F.col("text")).alias("text"))


@query(
    "limit_repeated_words",
    "D14",
    _sql_limit(f"regexp_extract_all(regexp_replace(text, '[a-z]', 'x', 'g'), '[^{_SP}]+')", "' '", "documents", "doc_id"),
)
def _(spark, d):
    masked = F.regexp_replace("text", "[a-z]", "x")  # makes long runs of equal words
    return text_table(spark, d, "documents").select("doc_id", tx.limit_repeated_words(masked).alias("text"))


@query("end_of_text_suffix", "C5", "SELECT doc_id, text || ' <|endoftext|>' AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.with_suffix(F.col("text")).alias("text"))


@query(
    "texts_of_script",
    "C7",
    r"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[\x{00C0}-\x{024F}]')",
)
def _(spark, d):
    return table(spark, d, "documents").where(tx.has_script(F.col("text"), ((0x00C0, 0x024F),))).select("doc_id", "lang")


@query(
    "non_empty_rows",
    "C4 A3",
    "SELECT doc_id, quality FROM (SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE text <> '' AND quality <> ''",
)
def _(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    both = both.withColumn("quality", F.col("quality").cast("string"))
    return both.where(non_empty("text", "quality")).select("doc_id", "quality")


@query(
    "drop_incomplete_rows",
    "C3",
    "SELECT doc_id, source, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND source IS NOT NULL",
)
def _(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", "source", "toxic").dropna(how="any", subset=["source", "toxic"])


@query("pruned_columns", "C1", "SELECT doc_id, n_chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars")


@query(
    "csv_quoted_lines",
    "B2",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\r\n]')
         THEN '"' || replace(text || ' <|endoftext|>', '"', '""') || '"'
         ELSE text || ' <|endoftext|>' END AS line FROM documents""",
)
def _(spark, d):
    from textloom.sinks.writers import corpus_lines

    docs = table(spark, d, "documents")
    return docs.select("doc_id", corpus_lines(docs, quoting="pandas").alias("line"))
