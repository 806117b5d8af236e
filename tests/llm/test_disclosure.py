"""Personal data and disclosing terms against plain Python; placeholders; odd rows."""

import hashlib
import math
import random
import re

import pytest
from pageloom.llm import disclosure as D
from pageloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\W_]+")


def luhn(digits):
    twice = [int(c) if i % 2 == 0 else int(c) * 2 for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    """``(kind, start, end, name, terms beside it with places)``."""
    out = []
    for kind, pattern in PLAIN.items():
        found = list(re.finditer(pattern, text or ""))
        edges = [0, *(x for m in found for x in m.span()), len(text or "")]
        for i, m in enumerate(found):
            if holds(kind, m[0]):
                name = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                out.append((kind, *m.span(), f"{kind}:{name}", beside(text, edges[2 * i], m.start(), m.end(), edges[2 * i + 3])))
    return out


def beside(text, left, start, end, right):
    before, after = text[left:start], text[end:right]
    if len(before) > D.REACH:
        before = WORD.sub("", before[-D.REACH :], count=1) if WORD.match(before[-D.REACH :]) else before[-D.REACH :]
    if len(after) > D.REACH:
        after = re.sub(r"[^\W_]+\Z", "", after[: D.REACH])
    words = lambda t, at: [(m[0].lower(), at + m.start(), at + m.end()) for m in WORD.finditer(t) if len(m[0]) >= D.LEAST]
    return words(before, start - len(before))[-D.TERMS :] + words(after, end)[: D.TERMS]


def brute(docs, generalise=D.GENERALISE, remove=D.REMOVE, support=D.SUPPORT):
    """The span list of every document, in order."""
    found = [base(text) for _, text in docs]
    both, texts, holders, terms = {}, {}, {}, {}
    for (_, text), spans in zip(docs, found):
        pairs = {(name, t) for _, _, _, name, near in spans for t, _, _ in near}
        for p in pairs:
            both[p] = both.get(p, 0) + 1
            texts.setdefault(p, set()).add(text)
        for name in {s[3] for s in spans}:
            holders[name] = holders.get(name, 0) + 1
        for t in {w.lower() for w in WORD.findall(text or "")}:
            terms[t] = terms.get(t, 0) + 1
    n = len(docs)

    def disclosure(pair):
        if len(texts[pair]) < support or holders[pair[0]] == n:
            return 0.0
        return math.log(both[pair] * n / (holders[pair[0]] * terms[pair[1]])) / math.log(n / holders[pair[0]])

    out = []
    for spans in found:
        told = {}
        for _, _, _, name, near in spans:
            for t, a, b in near:
                if not any(s[1] < b and a < s[2] for s in spans):
                    told[a, b] = max(told.get((a, b), 0.0), disclosure((name, t)))
        more = [("removed" if d >= remove else "generalised", a, b) for (a, b), d in told.items() if d >= generalise]
        out.append([s[:3] for s in spans] + sorted(more))
    return out


def as_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans_of(df):
    return {r.doc_id: r.s for r in df.select("doc_id", D.listed(F.col("spans")).alias("s")).collect()}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: spans for (i, _), spans in zip(docs, brute(docs))}
    rows = QUERIES["op12_disclosure"](spark, folder).collect()
    assert len(rows) == len(docs) and sum(bool(r.spans) for r in rows) > 5
    for r in rows:
        own = [s for s in want[r.doc_id] if s[0] in D.KINDS]
        assert r.spans == as_text(want[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in own) for k in D.KINDS]
        assert r.base_sha256 == hashlib.sha256(as_text(own).encode()).hexdigest()


def corpus():
    """Documents in which a few rare words go with one address or one number."""
    rng = random.Random(8)
    common = [f"word{i}" for i in range(30)]
    docs = []
    for i in range(80):
        body = rng.choices(common, k=40)
        if i % 8 == 0:
            body[10:10] = ["Falkenrath", "wrote", "jo.falk@mail.example.org", "about", "quixotry", str(i)]
        if i % 10 == 3:
            body[5:5] = ["call", "+49 30 1234-5678", "Zimmer", "417"]
        docs.append((i, " ".join(body)))
    docs += [(80 + i, f"quixotry {docs[3 + i][1]}") for i in range(3)]
    return docs


def test_disclosing_terms(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert {k for spans in want for k, _, _ in spans} == {"email", "phone", "removed", "generalised"}
    assert spans_of(D.personal_spans(table)) == {i: as_text(s) for (i, _), s in zip(docs, want)}
    clean = {r.doc_id: r.text for r in D.sanitise(table).collect()}
    assert "<email>" in clean[0] and "Falkenrath" not in clean[0] and "jo.falk" not in clean[0]
    assert "<phone>" in clean[13] and "1234" not in clean[13]
    assert clean[1] == docs[1][1]


def test_copies_of_one_text_are_no_evidence(spark):
    text = "Falkenrath wrote jo.falk@mail.example.org about quixotry"
    rows = [(i, text) for i in range(20)] + [(20 + i, f"plain text number {i}") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(D.personal_spans(table))[0] == "email:17:41"


CASES = [
    "a@b.c-d+e@f.g", "x..y@z.co.uk.", "a@b", "@a.b", "a@b..c", "a.b@c.d@e.f", "1.2.3.4.5", "256.1.1.1 001.002.003.004", "1.2.3",
    "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "1  2", "12 345 4111111111111111 6", "+1 (017) 555-7713", "+1-2",
    "+49 30 1234567890123", "+1 2 3 4 5 6 7 8 9.", "++1 555 777 888 9", "é😀 a@b.cd é 10.0.0.255", "+4111111111111111 x", "0" * 400 + ".1.1.1",
]


def test_patterns_equal_their_plain_forms(spark):
    rng = random.Random(2)
    more = ["".join(rng.choices("ab.@-+% 0123456789()é", weights=[3, 3, 3, 3, 2, 2, 1, 4, *[2] * 10, 1, 1, 1], k=60)) for _ in range(600)]
    docs = list(enumerate(CASES + more))
    got = spans_of(D.personal_spans(spark.createDataFrame(docs, "doc_id long, text string"), support=10**9))
    assert got == {i: as_text([s[:3] for s in base(t)]) for i, t in docs}


def test_long_texts(spark):
    """Long runs and many matches stay linear; none is lost."""
    texts = ["a" * 300_000 + "@", "a@b" + ".c" * 100_000, "1" * 300_000, "x@y.zz " * 20_000, "4111111111111111, " * 5_000, "+" * 100_000]
    got = spans_of(D.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [len(got[i].split(",")) if got[i] else 0 for i in range(6)] == [0, 1, 0, 20_000, 5_000, 0]
    assert got[3].endswith("email:139993:139999")


def test_odd_rows(spark):
    rows = [(None, None), (None, "a@b.cd"), (1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (3, "10.0.0.1 x")]
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, spans int, key string, digest long")
    found = D.personal_spans(docs)
    got = sorted((r.doc_id, r.s) for r in found.select("doc_id", D.listed(F.col("spans")).alias("s")).filter("doc_id IS NOT NULL").collect())
    assert got == [(1, ""), (2, ""), (3, "email:0:6"), (3, "email:0:6"), (3, "ip:0:8")]
    assert found.count() == len(rows)
    clean = D.sanitise(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == [
        (0, ""), (0, "<email>"), (1, ""), (2, ""), (3, "<email>"), (3, "<email>"), (3, "<ip> x"),
    ]
    assert D.personal_spans(docs.limit(0)).collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
