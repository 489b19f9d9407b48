"""Personal data and disclosing terms against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import catalog
from textloom.llm import disclosure as dc

# the base patterns as they are stated
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in STATED.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def entity(kind, value):
    return f"{kind}:{re.sub('[^0-9]', '', value) if kind in ('card', 'phone') else value.lower()}"


LETTERS = re.compile(r"[^\W\d_]+")


def nearby(text):
    spans = sorted((s, e, k, v) for k, s, e, v in base(text))
    ends, out = [], []
    for s in spans:
        ends.append(max(s[1], ends[-1] if ends else 0))
    for i, (s, _, k, v) in enumerate(spans):
        a, b = ends[i - 1] if i else 0, ends[i]
        stop = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        left = [(a + m.start(), m[0]) for m in LETTERS.finditer(text[a : max(a, s)])]
        right = [(b + m.start(), m[0]) for m in LETTERS.finditer(text[b : max(b, stop)])]
        # what stands before the first letter of a gap is a piece of its own
        lead = lambda t: bool(t) and not LETTERS.match(t)
        left = left[-(dc.NEAR + 1) :] if not lead(text[a : max(a, s)]) or len(left) > dc.NEAR else left
        right = right[: dc.NEAR + 1 - lead(text[b : max(b, stop)])]
        out += [(entity(k, v), w.lower(), p, p + len(w)) for p, w in left + right if len(w) >= dc.TERM_LETTERS]
    return out


def disclosed(rows):
    n, both, texts, ents, terms = len(rows), Counter(), defaultdict(set), Counter(), Counter()
    for _, t in rows:
        t = t or ""
        for p in {x[:2] for x in nearby(t)}:
            both[p] += 1
            texts[p].add(t)
        ents.update({entity(k, v) for k, _, _, v in base(t)})
        terms.update({w.lower() for w in LETTERS.findall(t) if len(w) >= dc.TERM_LETTERS})
    out = {}
    for p in both:
        e, t = p
        if len(texts[p]) >= dc.LEAST_TEXTS and ents[e] < n:
            ratio = math.log2(both[p] * n / (ents[e] * terms[t])) / math.log2(n / ents[e])
            if ratio >= dc.GENERALISED:
                out[p] = ratio >= dc.REMOVED
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "b", 3) for r in rows], "doc_id bigint, text string, private string, _spans int")
    out = dc.find(docs)
    assert out.columns == ["doc_id", "text", "_spans", "private"]
    got = out.collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)) == sorted((d is None, d or 0, t or "") for d, t in rows)
    pairs = disclosed(rows)
    for r in got:
        assert [tuple(s) for s in r.private.base] == base(r.text), r.text
        want = {}
        for e, t, a, b in nearby(r.text or ""):
            if (e, t) in pairs:
                want[a, b] = want.get((a, b), False) or pairs[e, t]
        assert [tuple(s) for s in r.private.terms] == [("term", a, b, x) for (a, b), x in sorted(want.items())], r.text
    return {(r.doc_id, r.text): r.private for r in got}


ODD = [
    "a@b.co, A.B+c%d_e@x-y.z.w. a@b a@.c @d.e x@y.c_d@e.f a@b.com@c.com", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 1.2.3.4.5 00256.1.1.1 0.0.0.0",
    "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111 5 5 5 378282246310005", "+49 (170) 123-4567 +1 +12 +123456789 +1234567890123456 +1 2345678( +44 20 7946 0958.",
    "é\U0001f600 x@y.zz \U0001f600 +441234567890 ñ 10.0.0.1", "+4111 1111 1111 1111 x1.2.3.4@5.6.7.8 1.2.3.4@host.org", None, "", " \n", "no data at all",
    "a" * 50_000 + "@", "1" * 50_000, "1 " * 5_000, "+1" * 5_000, "x.y@z.org " * 700, "9.9.9.9 word " * 300, "@" * 1000, "1." * 3000, "a@b." * 500,
]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ODD[0]), (None, ODD[0]), (None, None)]
    check(spark, rows)


def test_base_spans_of_random_texts(spark):
    rng = random.Random(8)
    alphabet = ["1", "2", "34", "5", "0", ".", "-", " ", "+", "@", "a", "B", "_", "%", "(", ")", "é", "\n", "4111111111111111", "255", "256", "x@y.z"]
    rows = [(i, "".join(rng.choices(alphabet, weights=[4] * 12 + [1] * 10, k=rng.randrange(0, 60)))) for i in range(1200)]
    check(spark, rows)


def corpus():
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("lor", "ip", "dol") for b in ("em", "sum", "or") for c in ("ata", "ing", "ely")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(40)) for i in range(80)]
    for i in range(5):  # a nickname that only ever stands beside one address
        rows.append((100 + i, f"{prose(10)} called Zanzibarian, ann.x@mail.org, {prose(12)}"))
    rows += [(200 + i, f"{rows[3][1]} Copyman bob@mail.org") for i in range(6)]  # one text, copied
    rows += [(300 + i, f"{prose(5)} Quorning {i} eve@mail.org 10.0.0.{i % 2} {prose(3)}") for i in range(20)] + [(400, "Quorning again " + prose(9))]
    return rows


def test_disclosing_terms(spark):
    found = check(spark, corpus())
    terms = {t[p.start : p.end].lower() for (_, t), private in found.items() for p in private.terms}
    assert "zanzibarian" in terms and "copyman" not in terms
    removed = {t[p.start : p.end].lower() for (_, t), private in found.items() for p in private.terms if p.removed}
    assert "zanzibarian" in removed and "quorning" not in removed and "quorning" in terms


def test_sanitised_texts(spark):
    rows = corpus() + [(None, None), (900, ""), (901, "Zanzibarian alone"), (902, "+4111 1111 1111 1111 and x@1.2.3.4")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, source string, _private int")
    out = dc.sanitised(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    # "called" stands beside that address only; the name does so in all texts but one
    assert "Zanzibarian" not in got[100] and "  <TERM>, <EMAIL>, " in got[100] and "called" not in got[100]
    assert got[0] == rows[0][1] and got[None] is None and got[900] == "" and got[901] == "Zanzibarian alone"
    assert "<TERM>" in got[300] and "<IP>" in got[300]
    assert "1111" not in got[902] and "1.2.3.4" not in got[902] and " and " in got[902]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_folds(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(100) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(dc.running_sums(F.col("v")).alias("s"), dc.running_maxima(F.col("v")).alias("m")).first()
    assert row.s == [sum(values[: i + 1]) for i in range(n)] and row.m == [max(values[: i + 1]) for i in range(n)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dc.find(docs).count() == 0 and dc.sanitised(docs).count() == 0


def test_registered_digest(spark, tmp_path):
    texts = ["write to a@b.co or +49 170 1234567, not 10.0.0.1", None, "", "4111 1111 1111 1111 and c@d.org, e@f.org", "no data"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.QUERIES["op2_disclosure"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = base(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)
        assert [got[i][f"n_{kind}"] for kind in dc.KINDS] == [sum(s[0] == kind for s in spans) for kind in dc.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[i].spans == joined


def test_strings_that_a_term_announces(spark):
    secret = lambda i: f"{i:02d}ab9f" * 4
    rows = [(i, f"Some words {i} token = \"{secret(i)}\" and more") for i in range(6)]
    rows += [(100 + i, f"the words of text {i} are plain") for i in range(200)]
    rows += [(400 + i, f"see the {secret(50 + i)} of it") for i in range(6)]  # behind an ordinary word
    rows += [(500, None), (502, f"token 1234567890123456 x{secret(3)}@mail.example.com")]
    found = {r.doc_id: r.private for r in dc.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(6):
        text = rows[i][1]
        assert [text[t.start : t.end] for t in found[i].terms] == [secret(i)]
    assert all(not found[i].terms for i in found if i >= 6)
    clean = {r.doc_id: r.text for r in dc.sanitised(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(secret(i) not in clean[i] for i in range(6)) and clean[401] == rows[207][1]
