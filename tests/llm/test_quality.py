"""Counts against plain Python, bounds against summed binomials, and the promise on given data."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pageloom.llm.quality import ALPHA, DELTA, LEVELS, PATH, judge, measure, upper_bound

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "a b a b a b", "x\nx\n\n \nx \nx", "é# ñ*%\n" * 3, "a\x0bb\x1cc a\x0bb\x1cc a", "1|2<>3 & $"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover))


@pytest.mark.parametrize("given", [True, False])
def test_counts(spark, given):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "a b c", None), (3, "a", "en"), (3, "a", "en")]
    if given:
        rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("n_chars < 4000").select("doc_id", "text", "lang").collect()]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, n_words int").repartition(3)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(map(tuple, measure(df).select("id", *names).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t, _ in rows), key=repr)


@pytest.mark.parametrize("k, n, delta", [(0, 50, 0.05), (3, 200, 0.01), (20, 300, 0.0125), (5, 5, 0.1)])
def test_upper_bound(k, n, delta):
    p = upper_bound(k, n, delta)
    if k == n:
        assert p == 1
    else:
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(delta, rel=1e-6)


def rows_of(good, bad):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(i, text + f" x{i}", "en") for i in range(good)] + [(good + i, text + " #$%" * 60, "en") for i in range(bad)]
    return docs, [(i, 1) for i in range(good)]


def test_enough_labels_reject_junk_and_few_do_not(spark):
    for good, rejects in ((1000, True), (60, False)):
        docs, labels = rows_of(good, 20)
        d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        kept = {r.doc_id: r.kept for r in judge(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
        lost = sum(not kept[i] for i in range(good))
        assert lost <= ALPHA * good
        assert [kept[good + i] for i in range(20)] == [not rejects] * 20


@pytest.mark.parametrize("same_ids", [True, False])
def test_copies_are_no_trials(spark, same_ids):
    """Sixty labelled texts allow no promise, however often they are repeated, under their ids or others."""
    docs, labels = rows_of(60, 20)
    more = [(i if same_ids or k == 0 else 1000 + 60 * k + i, text, lang) for i, text, lang in docs[:60] for k in range(20)]
    labels = [(i, 1) for i, _, _ in more]
    d = spark.createDataFrame(more + docs[60:], "doc_id long, text string, lang string")
    rows = judge(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept for r in rows) and len(rows) == 1220


def plain_levels(text):
    """The six measures in whole thousandths."""
    t = text or ""
    n, chars, symbols, dup, repeats = plain(t)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
    upper, marks = len(re.findall("[A-Z]", t)), len(re.findall("[!?]", t))
    shares = [(symbols, chars), (repeats, n), (dup, lines), (chars, n * 50), (upper, chars), (marks, n)]
    return [min(-(-a * LEVELS // b), LEVELS) if b else 0 for a, b in shares]


def plain_kept(rows, good_ids):
    """Verdicts by a loop over documents, for ids and texts that do not repeat."""
    fine = [n >= 50 and 100 * r <= 50 * n for n, _, _, _, r in (plain(t) for _, t, _ in rows)]
    measures = [plain_levels(t) for _, t, _ in rows]
    halves = defaultdict(lambda: ([], []))
    for (ident, _, stratum), ok, levels in zip(rows, fine, measures):
        if ok and ident in good_ids:
            halves[stratum][zlib.crc32(str(ident).encode()) % 2].append(levels)
    paths = {}
    for stratum, (first, _) in halves.items():
        if first:
            columns = list(zip(*first))
            paths[stratum] = [
                [min(x for x in range(LEVELS + 1) if sum(y > x for y in c) <= q * len(c)) for c in columns] for q in PATH
            ]
    cutoffs = {}
    for stratum, path in paths.items():
        second = halves[stratum][1]
        for step in range(len(path)):
            k = sum(any(x > c for cuts in path[: step + 1] for x, c in zip(levels, cuts)) for levels in second)
            if not second or upper_bound(k, len(second), DELTA / len(paths)) > ALPHA:
                break
            cutoffs[stratum] = path[step]
    gone = [s in cutoffs and any(x > c for x, c in zip(m, cutoffs[s])) for (_, _, s), m in zip(rows, measures)]
    return {row[0]: ok and not g for row, ok, g in zip(rows, fine, gone)}, cutoffs


def test_verdicts_against_plain_python(spark):
    random.seed(5)
    rows, good = [], set()
    for i in range(3600):
        stratum = random.choice(["en", "en", "de", None, "rare" if i % 40 == 0 else "en"])
        text = " ".join(f"w{random.randrange(5000)}" for _ in range(60))
        junk = i % 12 == 0
        text += " #$%&" * random.randrange(3, 40) if junk else random.choice(["", " A!", " #", "?\nX Y\nz"])
        rows.append((i, text + f" n{i}", stratum))
        if not junk or i % 360 == 0:
            good.add(i)
    want, cutoffs = plain_kept(rows, good)
    assert set(cutoffs) == {"en", "de", None}
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in judge(d, labels).collect()} == want
    assert Counter(want.values())[False] > 100


def test_very_long_text(spark):
    d = spark.createDataFrame([(1, "ab # " * 300_000, "en")], "doc_id long, text string, lang string")
    (row,) = judge(d, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert (row.n_words, row.n_symbols, row.base_failed) == (600_000, 300_000, True)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert judge(d, labels).count() == 0
    some = spark.createDataFrame([(1, "word " * 3, None)], "doc_id long, text string, lang string")
    assert [r.kept for r in judge(some, labels).collect()] == [False]
