"""Cleaning of text columns, as Column expressions only.

A script is a tuple of code point ranges. Whitespace is the Unicode set that
Python's ``str.strip`` uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges.
DEVANAGARI = ((0x0900, 0x097F),)
LATIN = ((0x41, 0x5A), (0x61, 0x7A), (0x00C0, 0x024F))
JOINERS = ((0x200C, 0x200D),)
ASCII_MARKS = ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))

# Regex class body of whitespace.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The look-behind lets a run of whitespace be tried once, not once per character.
END_SPACES = rf"^[{SPACES}]++|(?<![{SPACES}])[{SPACES}]++\z"

Ranges = tuple[tuple[int, int], ...]


def class_body(ranges: Ranges) -> str:
    """Regex class body of code point ranges; Java and RE2 read it alike."""
    return "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges)


def rest_body(ranges: Ranges) -> str:
    """Class body of every other character.

    The same set as ``[^...]``, which Java tests several times more slowly.
    """
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if at < lo:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return class_body((*out, (at, 0x10FFFF)))


END_OF_TEXT = "<|endoftext|>"

# Characters and their standard form.
STANDARD_FORMS = {
    "₹": "रु",
    "ʻ": "'",
    "ː": ":",
    "？": "?",
    "‟": '"',
    "“": '"',
    "”": '"',
    "`": "'",
    "৷": "।",
    "ˈ": "'",
    "՛": "'",
    "ǃ": "!",
    "（": "(",
    "：": ":",
    "ˍ": "_",
    "﹣": "-",
    "״": '"',
    "ꞌ": "'",
    "₋": "-",
    "％": "%",
    "꞉": ":",
    "‵": "'",
}

# Digits 0 to 9.
ASCII_DIGITS = "0123456789"
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, END_SPACES, "")


def collapse_spaces(col: Column) -> Column:
    """Runs of whitespace become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(col, rf"[{SPACES}]+", " "))


def split_words(col: Column) -> Column:
    """Words between whitespace, as Python's ``str.split`` gives them."""
    return F.array_remove(F.split(col, f"[{SPACES}]+", -1), "")


def standardise(col: Column) -> Column:
    """Replace quote, colon, dash and similar variants by their standard form.

    No standard form is itself a key, so one ``translate`` covers all
    one-to-one pairs and the order does not matter.
    """
    single = {k: v for k, v in STANDARD_FORMS.items() if len(v) == 1}
    out = F.translate(col, "".join(single), "".join(single.values()))
    for key, form in STANDARD_FORMS.items():
        if len(form) > 1:
            out = F.replace(out, F.lit(key), F.lit(form))
    return out


def native_digits(col: Column, digits: str = DEVANAGARI_DIGITS) -> Column:
    return F.translate(col, ASCII_DIGITS, digits)


def has_script(col: Column, script: Ranges = DEVANAGARI) -> Column:
    return col.rlike(f"[{class_body(script)}]")


def keep_script(col: Column, script: Ranges = DEVANAGARI, punctuation: bool = True, keep_joiners: bool = False) -> Column:
    """Keep the characters of one script and spaces, and punctuation in context.

    With ``punctuation`` an ASCII mark stays where the next character is of the
    script, or at the text end after kept text; every other run of characters
    becomes one space. Without it each other character becomes a space.
    """
    if keep_joiners:
        script = (*script, *JOINERS)
    letter, mark = class_body(script), class_body(ASCII_MARKS)
    if not punctuation:
        return F.regexp_replace(col, f"[{rest_body((*script, (0x20, 0x20)))}]", " ")
    other = rest_body((*script, *ASCII_MARKS, (0x20, 0x20)))
    # marks before a space or foreign text go, and of several marks all but the last
    last_mark = F.regexp_replace(col, rf"[{mark}]+(?![{letter}{mark}]|\z)|[{mark}]+(?=[{mark}](?:[{letter}]|\z))", "")

    def cut_ends(text: Column) -> Column:
        # foreign text at the ends, with a closing mark that has no kept text before it
        at_end = rf"(?<![{other}])[{other}]++[{mark}]?\z"  # tried once per run
        cut = F.regexp_replace(text, rf"{at_end}|^[{other}]++|^[{mark}]\z", "")
        foreign = F.substring(text, 1, 1).rlike(f"[{other}{mark}]") | F.substring(text, -2, 2).rlike(f"[{other}]")
        return F.when(foreign, cut).otherwise(text)

    return F.regexp_replace(let(last_mark, cut_ends), f"[{other}]+", " ")


def clean(
    col: Column, script: Ranges = DEVANAGARI, digits: str | None = DEVANAGARI_DIGITS, markup: bool = True, **options
) -> Column:
    """Markup text, standard characters, native digits, script filter, spaces."""
    from textloom.functions.html import html_text

    out = html_text(col) if markup else col
    out = standardise(out)
    if digits:
        out = native_digits(out, digits)
    # only plain spaces are left
    return F.trim(F.regexp_replace(keep_script(out, script, **options), " {2,}", " "))


def drop_punctuation_and_digits(col: Column) -> Column:
    """Delete ASCII marks, the double danda and digits; collapse spaces, no trim."""
    removed = F.regexp_replace(col, rf"[{class_body(ASCII_MARKS)}\x{{0965}}0-9\x{{0966}}-\x{{096F}}]", "")
    return F.regexp_replace(removed, rf"[{SPACES}]+", " ")


def cut_between(col: Column, start: str, end: str, strict: bool = False, after_start: bool = False) -> Column:
    """From the first ``start`` (kept) up to the first ``end`` (dropped).

    Both are searched from the beginning, so an ``end`` that comes first gives
    an empty text; ``after_start`` searches it behind ``start`` instead. An
    absent mark gives null, or fails the job with ``strict``.
    """
    i = F.instr(col, start)
    j = F.locate(end, col, 1)
    if after_start:
        tail = F.substr(col, i + F.lit(len(start)))
        j = F.when(F.instr(tail, end) > 0, F.instr(tail, end) + i + F.lit(len(start) - 1)).otherwise(F.lit(0))
    absent = F.raise_error(F.lit(f"mark {start!r} or {end!r} not in text")).cast("string") if strict else F.lit(None).cast("string")
    return F.when((i == 0) | (j == 0), absent).otherwise(F.substr(col, i, F.greatest(j - i, F.lit(0))))


def after_header(col: Column, header_end: str) -> Column:
    """Stripped text behind the first ``header_end``; unchanged where it is absent."""
    i = F.instr(col, header_end)
    return F.when(i > 0, strip(F.substr(col, i + F.lit(len(header_end))))).otherwise(col)


def drop_marker(col: Column, marker: str = "<|eot_id|>") -> Column:
    return F.replace(col, F.lit(marker), F.lit(""))


def cut_at_markers(col: Column, markers: tuple[str, ...] = (END_OF_TEXT, "<|eot_id|>")) -> Column:
    """Everything before the first occurrence of any marker."""
    for marker in markers:
        col = F.substring_index(col, marker, 1)
    return col


def _limit_repeats(items: Column, most: int) -> Column:
    def keep(a: Column) -> Column:
        def differs(x: Column, i: Column) -> Column:
            same = F.lit(True)
            for back in range(1, most + 1):
                same = same & (x == F.get(a, i - F.lit(back)))
            return (i < most) | ~same

        return F.filter(a, differs)

    return let(items, keep)


def limit_repeated_lines(col: Column, most: int = 3) -> Column:
    """At most ``most`` identical lines in a row."""
    return F.array_join(_limit_repeats(F.split(col, "\n", -1), most), "\n")


def limit_repeated_words(col: Column, most: int = 3) -> Column:
    """At most ``most`` identical words in a row; the result is single-spaced."""
    return F.array_join(_limit_repeats(split_words(col), most), " ")


def tidy_reply(col: Column) -> Column:
    """Cut at markers, then limit repeated lines and words."""
    return limit_repeated_words(limit_repeated_lines(cut_at_markers(col)))


def with_suffix(col: Column, suffix: str = " " + END_OF_TEXT) -> Column:
    return F.concat(col, F.lit(suffix))


def minimal_csv_quoting(col: Column) -> Column:
    """The text as a one-column CSV writer with minimal quoting prints it."""
    quoted = F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(col.rlike('[,"\r\n]') | (col == ""), quoted).otherwise(col)
