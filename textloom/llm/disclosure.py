"""Personal data and what gives it away, in DataFrame expressions only.

Four patterns find personal data as spans of a text. The corpus then tells which
other words disclose it: for an entity (a personal value) and a term near it,
documents with either and with both give their pointwise mutual information
``PMI = log2(n_both * N / (n_entity * n_term))``. It reaches the entity's
information content ``IC = log2(N / n_entity)`` when the term occurs with the
entity only, so that the term alone gives it away. From ``GENERALISED`` of
``IC`` on a term is generalised, from ``REMOVED`` on removed, wherever it stands
near that entity. Chance meetings are no evidence: a pair counts once it is
found in ``LEAST_TEXTS`` different texts, so copies of one text do not suffice.

Terms are runs of letters, lower-cased, of ``TERM_LETTERS`` or more. Near means
among the ``NEAR`` terms before or after the entity, up to the next entity.

Secrets are mostly unique, so no value says what they are; what announces them
does. All opaque strings (``OPAQUE`` characters or more, letters and digits
mixed) are one entity, ``CLASS``, and the term right before one is near it. A
term over the threshold (``token``, say, if it hardly ever stands elsewhere)
discloses what it announces, and the strings behind it are taken out. Opaque
strings behind ordinary words stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.divergence import let
from textloom.plans.shared_dir import materialise

NEAR = 6
TERM_LETTERS = 2
OPAQUE = 16
CLASS = "class:opaque"
LEAST_TEXTS = 3
GENERALISED, REMOVED = 0.9, 0.98  # of the entity's information content

_CHUNK = 256

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

# The fixed patterns, spelled so that a search never goes back over a run: a match can only begin where a run of
# its first class begins, or where the match before it has ended (\G), and no part gives characters back.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]++)++",
}
_NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|(?<=0))"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(values: Column, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running fold of an int array, each value included; in chunks, so that its cost stays near linear."""

    def in_chunks(a: Column) -> Column:
        n = F.floor((F.size(a) - 1) / _CHUNK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n), lambda c: F.slice(a, c * _CHUNK + 1, F.lit(_CHUNK)))

        def of_chunk(whole: Column) -> Column:
            sums = F.transform(whole, fold)
            step = lambda acc, x: F.concat(acc, F.array(both(F.element_at(acc, -1), x)))
            one = lambda part, base: F.slice(F.aggregate(part, F.array(base), step), F.lit(2), F.size(part))
            before = let(sums, lambda s: F.transform(s, lambda _, c: fold(F.concat(F.array(F.lit(zero)), F.slice(s, F.lit(1), c)))))
            return F.flatten(F.zip_with(whole, before, one))

        return let(cut, of_chunk)

    return F.when(F.size(values) > 0, let(values, in_chunks)).otherwise(F.array().cast("array<int>"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def running_sums(values: Column) -> Column:
    return _running(values, _sum, lambda a, b: a + b, 0)


def running_maxima(values: Column) -> Column:
    return _running(values, F.array_max, F.greatest, 0)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _spans_of(kind: str, text: Column) -> Column:
    """Spans of one kind, in order: leftmost matches that do not overlap, those that fail its rule dropped."""
    pattern = F.lit(_PATTERNS[kind])

    def placed(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: gap + F.length(m))
        spans = F.zip_with(running_sums(steps), found, lambda end, m: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")
        ))
        return F.filter(spans, lambda s: _valid(kind, s["value"]))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    maybe = text.contains(_NEEDED[kind]) if _NEEDED[kind] else text.rlike("[0-9]")
    return F.when(maybe, let(found, lambda f: F.when(F.size(f) > 0, placed(f)))).otherwise(F.lit(None))


def personal_spans(text: Column) -> Column:
    """Personal data in a text: ``kind, start, end, value`` by kind and start, in code points, end exclusive."""
    none = F.array().cast(_SPAN)
    return F.concat(*[F.coalesce(_spans_of(k, text).cast(_SPAN), none) for k in KINDS])


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]+", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= TERM_LETTERS))


_ANNOUNCED = "array<struct<term:string,start:int,end:int>>"
_OPAQUE = rf"[A-Za-z0-9_-]{{{OPAQUE},}}+"


def announced(text: Column, spans: Column) -> Column:
    """Opaque strings outside of ``spans``, each with the term before it: a run of letters and up to eight other characters."""
    pattern = F.lit(rf"(?<!\p{{L}})\p{{L}}{{{TERM_LETTERS},}}+[^\p{{L}}\p{{N}}]{{1,8}}+{_OPAQUE}")

    def placed(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: gap + F.length(m))
        values = F.zip_with(running_sums(steps), found, lambda end, m: F.struct(
            F.lower(F.regexp_extract(m, r"^\p{L}+", 0)).alias("term"), (end - F.length(F.regexp_extract(m, rf"{_OPAQUE}\z", 0))).alias("start"),
            end.alias("end"), F.regexp_extract(m, rf"{_OPAQUE}\z", 0).alias("value"),
        ))
        mixed = F.filter(values, lambda v: v["value"].rlike("[0-9]") & v["value"].rlike("[A-Za-z]"))
        apart = F.filter(mixed, lambda v: ~F.exists(spans, lambda x: (x["start"] < v["end"]) & (v["start"] < x["end"])))
        return F.transform(apart, lambda v: F.struct(v["term"], v["start"], v["end"])).cast(_ANNOUNCED)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    maybe = text.rlike(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{OPAQUE}}}")
    none = F.array().cast(_ANNOUNCED)
    return F.when(maybe, let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))).otherwise(none)


_NEARBY = "array<struct<entity:string,term:string,start:int,end:int>>"


def _near(text: Column, spans: Column) -> Column:
    """Terms near each entity, with their places. Gaps between entities hold no part of one."""

    def pieces(gap: Column, start: Column, entity: Column, last: Column) -> Column:
        # runs of letters, each with what follows it up to the next; the first may be only what comes before a letter
        def located(runs: Column) -> Column:
            chosen = F.when(last, F.slice(runs, F.greatest(F.size(runs) - NEAR, F.lit(1)), F.lit(NEAR + 1))).otherwise(F.slice(runs, 1, NEAR + 1))
            total = lambda a: _sum(F.transform(a, lambda x: F.length(x)))

            def places(part: Column) -> Column:
                base = F.when(last, start + F.length(gap) - total(part)).otherwise(start)
                return let(base, lambda b: F.transform(part, lambda x, i: F.struct(
                    F.regexp_extract(x, r"^\p{L}+", 0).alias("word"), (b + total(F.slice(part, F.lit(1), i))).alias("at")
                )))

            return let(chosen, places)

        words = F.filter(let(F.split(gap, r"(?<=[^\p{L}])(?=\p{L})"), located), lambda w: F.length(w["word"]) >= TERM_LETTERS)
        return F.transform(words, lambda w: F.struct(
            entity.alias("entity"), F.lower(w["word"]).alias("term"), w["at"].alias("start"), (w["at"] + F.length(w["word"])).alias("end")
        ))

    def around(ordered: Column) -> Column:
        def gaps(ends: Column) -> Column:
            def both(s: Column, i: Column) -> Column:
                begin = F.coalesce(F.get(ends, i - 1), F.lit(0))
                after = F.get(ends, i)
                stop = F.coalesce(F.get(ordered, i + 1)["start"], F.length(text))
                left = F.substring(text, begin + 1, F.greatest(s["start"] - begin, F.lit(0)))
                right = F.substring(text, after + 1, F.greatest(stop - after, F.lit(0)))
                return F.concat(
                    let(left, lambda g: pieces(g, begin, _entity(s), F.lit(True))), let(right, lambda g: pieces(g, after, _entity(s), F.lit(False)))
                )

            return F.flatten(F.transform(ordered, both))

        return let(running_maxima(F.transform(ordered, lambda s: s["end"])), gaps)

    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return let(by_start, around).cast(_NEARBY)


def _counted(nearby: DataFrame, docs: DataFrame, n_docs: int, least_texts: int, generalised: float, removed: float) -> DataFrame:
    """Pairs ``entity, term, ratio, removed`` over the threshold. All documents count, combined before each shuffle."""
    of_row = lambda *cols: F.array_distinct(F.transform("_near", lambda x: F.struct(*[x[c].alias(c) for c in cols])))
    pairs = nearby.select("_print", F.explode(of_row("entity", "term")).alias("p")).groupBy("p.entity", "p.term", "_print").agg(F.count("*").alias("n"))
    own = nearby.select("_print", F.explode(F.array_distinct(F.transform("_announced", lambda x: x["term"]))).alias("term"))
    own = own.groupBy(F.lit(CLASS).alias("entity"), "term", "_print").agg(F.count("*").alias("n"))
    pairs = pairs.unionByName(own).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= least_texts)
    pairs = materialise(pairs, "near-pairs")
    entities = nearby.select(F.explode(F.array_distinct(F.transform("_spans", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    of_class = nearby.where(F.size("_announced") > 0).agg(F.count("*").alias("n_entity")).select(F.lit(CLASS).alias("entity"), "n_entity")
    entities = entities.unionByName(of_class)
    terms = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    known = pairs.join(entities, "entity").join(terms, "term")
    pmi = F.log2(F.col("n_both") * F.lit(float(n_docs)) / (F.col("n_entity") * F.col("n_term")))
    content = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))  # 0 for an entity in every document: nothing to learn
    rated = known.withColumn("ratio", F.when(content > 0, pmi / content)).where(F.col("ratio") >= generalised)
    return materialise(rated.select("entity", "term", "ratio", (F.col("ratio") >= removed).alias("removed")), "disclosing-pairs")


_FOUND = "array<struct<kind:string,start:int,end:int,removed:boolean>>"


def find(
    docs: DataFrame,
    name: str = "private",
    with_text: bool = True,
    least_texts: int = LEAST_TEXTS,
    generalised: float = GENERALISED,
    removed: float = REMOVED,
) -> DataFrame:
    """``docs`` with a struct column ``name``: ``base`` and ``terms``.

    ``base`` are the personal spans (``kind, start, end, value``), by kind and
    start; ``terms`` the disclosing terms near them (``kind, start, end,
    removed``), by start, which never overlap a base span. Null and empty texts
    have none, nor has a text without personal data. What a text holds depends
    on the text and the corpus alone: repeated rows get the same, whatever
    their ids. Other columns are kept, save one called ``name``, which is
    replaced, and ``text`` unless ``with_text``. Empty in, empty out.
    """
    kept = [c for c in docs.columns if c != name]
    inside = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.coalesce("text", F.lit("")).alias("text"))
    keyed = inside.withColumn("_spans", personal_spans(F.col("text"))).withColumn("_announced", announced(F.col("text"), F.col("_spans")))
    prints = [F.xxhash64("text").alias("_print"), F.xxhash64(F.lit(1), F.col("text")).alias("_more")]
    private = keyed.where((F.size("_spans") > 0) | (F.size("_announced") > 0))
    nearby = materialise(private.select(*prints, "_spans", "_announced", _near(F.col("text"), F.col("_spans")).alias("_near")), "near-entities")
    pairs = _counted(nearby, inside, docs.count(), least_texts, generalised, removed)

    texts = nearby.dropDuplicates(["_print", "_more"])
    classed = F.transform("_announced", lambda x: F.struct(F.lit(CLASS).alias("entity"), x["term"].alias("term"), x["start"].alias("start"), x["end"].alias("end")))
    places = texts.select("_print", "_more", F.explode(F.concat("_near", classed.cast(_NEARBY))).alias("x"))
    places = places.select("_print", "_more", "x.*").join(pairs.select("entity", "term", "removed"), ["entity", "term"])
    places = places.groupBy("_print", "_more", "start", "end").agg(F.max("removed").alias("removed"))
    span = F.struct(F.lit(TERM).alias("kind"), "start", "end", "removed")
    terms = places.groupBy("_print", "_more").agg(F.sort_array(F.collect_list(span)).cast(_FOUND).alias("_terms"))  # of one text each
    terms = materialise(terms, "disclosing-terms")
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept) if with_text or c != "text"]
    found = keyed.select(*[f"c{i}" for i, c in enumerate(kept) if with_text or c != "text"], *prints, "_spans")
    found = found.join(terms, ["_print", "_more"], "left")
    none = F.array().cast(_FOUND)
    return found.select(*columns, F.struct(F.col("_spans").alias("base"), F.coalesce("_terms", none).alias("terms")).alias(name))


def redacted(text: Column, private: Column) -> Column:
    """The text with personal data replaced by ``<KIND>``, generalised terms by ``<TERM>`` and removed ones by nothing."""

    def cut(spans: Column) -> Column:
        def parts(ends: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                begin = F.coalesce(F.get(ends, i - 1), F.lit(0))
                before = F.substring(text, begin + 1, F.greatest(s["start"] - begin, F.lit(0)))
                return F.concat(before, F.when(s["end"] > begin, s["tag"]).otherwise(F.lit("")))

            rest = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
            return F.concat(F.array_join(F.transform(spans, one), ""), rest)

        return F.when(F.size(spans) > 0, let(running_maxima(F.transform(spans, lambda s: s["end"])), parts)).otherwise(text)

    tag = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    base = F.transform(private["base"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(s).alias("tag")))
    terms = F.transform(private["terms"], lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.when(s["removed"], F.lit("")).otherwise(tag(s)).alias("tag")
    ))
    return F.when(text.isNotNull(), let(F.sort_array(F.concat(base, terms)), cut))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, personal data and disclosing terms of ``text`` taken out. Null stays null."""
    name = "_private"
    while name in docs.columns:
        name += "_"
    found = find(docs, name)
    return found.select(*[redacted(F.col("text"), F.col(name)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
