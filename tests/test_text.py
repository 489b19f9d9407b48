"""Cleaning expressions against plain statements of their rules."""

import itertools
import random
import string

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.html import html_text


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def kept(text, is_letter):
    """The script rule by runs of one kind: kept text, marks, anything else."""

    def kind(c):
        return "keep" if is_letter(c) or c == " " else "mark" if c in string.punctuation else "break"

    runs = [(k, "".join(g)) for k, g in itertools.groupby(text, kind)]
    segments = [""]
    for (k, run), (_, following) in zip(runs, [*runs[1:], ("end", "")]):
        if k == "break":
            segments.append("")
        elif k == "keep":
            segments[-1] += run
        elif is_letter(following[:1] or " ") or (not following and segments[-1]):
            segments[-1] += run[-1]
    return " ".join(s for s in segments if s)


def devanagari(c):
    return "ऀ" <= c <= "ॿ"


def latin(c):
    return c in string.ascii_letters or "À" <= c <= "ɏ"


SENTENCE = "उनले दुहेको दूध बेच्नका लागि बजार असाध्यै सानो थियो त्यसैले उनले चीज बनाउने विचार गरे।"


def test_keep_script_stated_cases(spark):
    texts = [
        SENTENCE + ' "hi there". what is your name? उनले दुहेको दूध',
        '"hi there. "उनले दुहेको" दूध बेच्नका। hi there. what is your name? उनले दुहेको दूध"',
        'name? उनले दुहेको दूध"',
    ]
    got = column(spark, texts, lambda c: tx.collapse_spaces(tx.keep_script(c)))
    assert got == [
        SENTENCE + " उनले दुहेको दूध",
        '"उनले दुहेको दूध बेच्नका। उनले दुहेको दूध"',
        'उनले दुहेको दूध"',
    ]


def test_keep_script_random(spark):
    rnd = random.Random(7)
    alphabet = ["क", "ा", "।", "a", "é", "Z", "1", ".", ",", '"', "-", " ", " ", "\n", "‍", "\U0001f600", "�"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(6000)]
    assert column(spark, texts, tx.keep_script) == [kept(t, devanagari) for t in texts]
    assert column(spark, texts, lambda c: tx.keep_script(c, tx.LATIN)) == [kept(t, latin) for t in texts]


def test_keep_script_without_punctuation(spark):
    got = column(spark, ["क, ख‍ग😀1"], lambda c: tx.keep_script(c, punctuation=False))
    assert got == ["क  ख ग  "]


def test_joiners(spark):
    word = ["क्‍ष"]
    assert column(spark, word, tx.keep_script) == ["क् ष"]
    assert column(spark, word, lambda c: tx.keep_script(c, keep_joiners=True)) == word


def test_standard_forms_and_digits(spark):
    assert column(spark, ["₹50 “क” ｀ `ख` ग： ৷"], tx.standardise) == ["रु50 \"क\" ｀ 'ख' ग: ।"]
    assert column(spark, ["a0123456789"], tx.native_digits) == ["a०१२३४५६७८९"]


def test_clean(spark):
    page = "<p>सुर्खेत र  &amp; <b>जुम्ला</b></p><style> बाहेक </style><script>x('क');</script> २ 3"
    assert column(spark, [page, None, ""], tx.clean) == ["सुर्खेत र जुम्ला २ ३", None, ""]


def test_clean_keeps_line_break_rule(spark):
    # a mark behind a line break has no kept text before it; behind a space it has
    assert column(spark, ["क\n,", "क ,"], lambda c: tx.clean(c)) == ["क", "क ,"]


def test_html(spark):
    pages = [
        "<html><h1>Hi there</h1><style>color:red</style><script>console.log('x');</script>Example text</html>",
        "a<!-- gone --><b> b\n c </b>&nbsp;d &lt;e&gt; &amp;lt;&&amp;#38; &#0;&#xD800; &#2325;&#x915; &unknown;",
        "",
        "no markup < here & there",
        "open tag <b never closed",
        "a<script>x <!-- </script>b<!-- <script> -->c<style>p{} </style >d<SCRIPT>never closed",
    ]
    want = ["Hi there Example text", "a b\n c d <e> &lt;&&#38; &#0;&#xD800; कक &unknown;", "", "no markup < here & there", "open tag", "a b c d"]
    assert column(spark, pages, html_text) == want


def test_html_quotes_and_names(spark):
    pages = [
        "<p>it&apos;s</p>", '<a title="x > y">link</a> z', "a&nbspb &copy2 &ampx &notit;", "<p title=it's>don't</p>", "<i a='>\">'>k</i>",
        "1 &NotEqualTilde; 2 &fjlig; &semi;&equals; &unknown; &#39;", '<b a="open>t</b>', "<a " + "=" * 50_000 + ">x",
    ]
    want = ["it's", "link z", "a\xa0b ©2 &x ¬it;", "don't", "k", "1 ≂̸ 2 fj ;= &unknown; '", "t", "x"]
    assert column(spark, pages, html_text) == want


def test_spaces(spark):
    assert column(spark, [" a \n\tb ", "", "　"], tx.collapse_spaces) == ["a b", "", ""]
    assert column(spark, [" a b  c", "", " "], tx.split_words) == [["a", "b", "c"], [], []]
    assert column(spark, ["\x1c a b "], tx.strip) == ["a b"]


def test_drop_punctuation_and_digits(spark):
    assert column(spark, ["क, ख॥ 12\n३ग।"], tx.drop_punctuation_and_digits) == ["क ख ग।"]


def test_cut_between(spark):
    texts = ["x <a> mid <b> y", "<b> first <a> then <b>", "none"]
    assert column(spark, texts, lambda c: tx.cut_between(c, "<a>", "<b>")) == ["<a> mid ", "", None]
    assert column(spark, texts, lambda c: tx.cut_between(c, "<a>", "<b>", after_start=True)) == ["<a> mid ", "<a> then ", None]


def test_cut_between_strict(spark):
    df = spark.createDataFrame([("x <a> mid <b>",)], "t string")
    strict = df.select(tx.cut_between(F.col("t"), "<a>", "<b>", strict=True).alias("o"))
    assert strict.collect()[0].o == "<a> mid "
    with pytest.raises(Exception, match="not in text"):
        df.select(tx.cut_between(F.col("t"), "<a>", "<z>", strict=True)).collect()


def test_reply_cleaning(spark):
    head = "assistant<|end_header_id|>\n\n"
    assert column(spark, ["q" + head + " hello ", "plain "], lambda c: tx.after_header(c, head)) == ["hello", "plain "]
    assert column(spark, ["a<|eot_id|>b\nc<|endoftext|>"], tx.cut_at_markers) == ["a"]
    assert column(spark, ["a<|eot_id|>b"], tx.drop_marker) == ["ab"]


def limited(items, most=3):
    out = []
    for x in items:
        if len(out) >= most and all(y == x for y in out[-most:]):
            continue
        out.append(x)
    return out


def test_limited_repeats_random(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("aab") for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    assert column(spark, texts, tx.limit_repeated_words) == [" ".join(limited(t.split())) for t in texts]
    lines = [t.replace(" ", "\n") + "\n" for t in texts]
    assert column(spark, lines, tx.limit_repeated_lines) == ["\n".join(limited(t.split("\n"))) for t in lines]


def test_minimal_csv_quoting(spark):
    import io

    import pandas as pd

    texts = ["plain", 'say "hi"', "a, b", "two\nlines", " lead"]
    out = io.StringIO()
    pd.Series(texts).to_csv(out, index=False, header=False)
    assert "\n".join(column(spark, texts, tx.minimal_csv_quoting)) + "\n" == out.getvalue()


def test_long_runs_take_linear_time(spark):
    import time

    n = 300_000
    runs = ["中" * n + "x.", "x" + " " * n + "x", "." * n + "x" + "." * n, "<a" * n, "&" * n, "&#x915;&amp;" * (n // 20), "x <!--" + " <p " * n, "a " * n]
    start = time.time()
    for clean in (tx.clean, lambda c: tx.clean(c, tx.LATIN), tx.strip, tx.collapse_spaces, html_text):
        assert len(column(spark, runs, clean)) == len(runs)
    assert time.time() - start < 60


def test_cleaning_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("x",)], "t string").select(tx.clean(F.col("t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
