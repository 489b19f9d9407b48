"""Text of an HTML page, in the JVM.

Comments, ``script`` and ``style`` blocks and tags end a text node; every text
node is stripped and nodes are joined by one space. Whitespace inside a node is
kept. Malformed markup is read by these rules, not by a browser's repair rules.
A ``>`` in a quoted attribute value does not end its tag.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import SPACES, let, strip

_NODE_END = "\ue000"  # private use: stands for a markup boundary

# One pass, so that a comment in a script and a script in a comment end where they should.
# What is never closed runs to the end of the page.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""  # a quote opens a value only behind its equals sign
_MARKUP = (
    rf"(?is)<(?:!--.*?(?:-->|\z)|script\b{_ATTRIBUTES}>.*?(?:</script\s*>|\z)|style\b{_ATTRIBUTES}>.*?(?:</style\s*>|\z)"
    rf"|[!?][^>]*+(?:>|\z)|[/a-z]{_ATTRIBUTES}(?:>|\z))"
)
# Names of old stand without a semicolon too, the longest one counts.
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
_ENTITIES = ("^((?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)", f"^({_BARE})")


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


_LONGEST = max(len(name) for name in html5)
_A = ord("A")  # a name begins with a letter


def _names_by_place() -> str:
    """Names and characters as `` name=chars ``, a line for each first letter and length."""
    lines = [""] * ((ord("z") - _A + 1) * _LONGEST)
    for name, chars in sorted(html5.items()):
        if name.endswith(";") and chars != "\n":
            lines[(ord(name[0]) - _A) * _LONGEST + len(name) - 1] += f" {name[:-1]}={chars} "
    return "\n".join(lines)


_NAMES = _names_by_place()


def _named_char(name: Column) -> Column:
    """The character of a name; only the names of its first letter and length are compared."""
    place = F.when(F.length(name) < _LONGEST, (F.ascii(name) - _A) * _LONGEST + F.length(name))
    entry = F.concat(F.lit(" "), name, F.lit("="))

    def found(names: Column) -> Column:
        rest = F.substr(names, F.instr(names, entry) + F.length(entry))
        return F.when(F.contains(names, entry), F.substring_index(rest, " ", 1))

    return F.when(name == "NewLine", F.lit("\n")).otherwise(let(F.get(F.split(F.lit(_NAMES), "\n", -1), place), found))


def _entity_char(name: Column) -> Column:
    """The character of an entity name, null when the name is unknown."""
    hexadecimal = F.conv(F.substr(name, F.lit(3)), 16, 10).cast("bigint")
    decimal = F.substr(name, F.lit(2)).cast("bigint")
    number = F.when(name.rlike("^#[xX]"), hexadecimal).otherwise(decimal)

    def numbered(n: Column) -> Column:
        valid = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(valid, _code_point(n))

    return F.when(name.startswith("#"), let(number, numbered)).otherwise(_named_char(name))


def decode_entities(col: Column) -> Column:
    """Decode named and numeric entities, each text position once.

    The text is cut at ampersands and each part looks at its own beginning, so
    the work is one pass whatever the number of entities.
    """

    def decode(part: Column, i: Column) -> Column:
        plain = F.concat(F.lit("&"), part)

        def replaced(found: Column) -> Column:
            rest = F.substr(part, F.length(found) + 1)
            char = let(_entity_char(F.rtrim(found, F.lit(";"))), lambda c: F.concat(c, rest))
            return F.when(found != "", char)

        tried = [let(F.regexp_extract(part, pattern, 1), replaced) for pattern in _ENTITIES]
        return F.when(i == 0, part).otherwise(F.coalesce(*tried, plain))

    whole = F.array_join(F.transform(F.split(col, "&", -1), decode), "")
    return F.when(F.contains(col, F.lit("&")), whole).otherwise(col)


def html_text(col: Column) -> Column:
    out = let(F.regexp_replace(col, _MARKUP, _NODE_END), decode_entities)
    out = F.regexp_replace(out, f"(?<![{SPACES}])[{SPACES}]*+{_NODE_END}[{SPACES}{_NODE_END}]*", " ")
    return strip(out)
