"""Importance resampling against plain Python: buckets, histograms, gains, noise, ranks, odd rows."""

import hashlib
import math
import re
import zlib

import pytest
from pageloom.llm import importance as R
from pageloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, percent=25, least=20, seed=7):
    """``{id: (n_features, weight, score, rank)}``."""
    s, t = [0] * 10_000, [0] * 10_000
    own = {i: features(x) for i, x in docs}
    for _, f in own.values():
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = {}
    for i, (n, f) in own.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in own if own[i][0] >= least), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def got(rows):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in rows}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = QUERIES["op11_importance_resampling"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert got(rows) == brute(docs, target)


def test_words_are_cut_between_words(monkeypatch):
    text = "Ab-9 é漢字's x\x00y " * 50 + "z" * 300
    whole = R.words(text.lower())
    assert whole == [w.encode() for w in WORD.findall(text.lower())]
    for cut in (1, 7, 64):
        monkeypatch.setattr(R, "CUT", cut)
        assert R.words(text.lower()) == whole


def test_longer_runs(spark):
    n, buckets = R.feature_buckets("one two three four".encode(), order=3)
    runs = ["one", "two", "three", "four", "one two", "two three", "three four", "one two three", "two three four"]
    assert n == 4 and buckets.tolist() == [zlib.crc32(r.encode()) % 10_000 for r in runs]


ODD = [
    (None, None), (1, None), (2, ""), (3, "...!"), (4, "w " * 40), (5, "w " * 40), (5, "w " * 40), (6, "Ω é " * 30),
    (7, "long words " * 60_000), (8, "x" * 300_000 + " y" * 30), (None, "no id " * 12),
]


def test_odd_rows(spark):
    """Nulls, empty, very long, equal and repeated rows; clashing extra columns."""
    docs = spark.createDataFrame(
        [(i, t, 1, 2, "p") for i, t in ODD], "doc_id long, text string, score int, position int, features string"
    )
    target = spark.createDataFrame([(1, "w w"), (2, None)], "item_id long, text string")
    rows = R.resample(docs, target).collect()
    assert len(rows) == len(ODD)
    want = brute([(i, t) for i, t in {(k if k is not None else ""): v for k, v in ODD}.items()], ["w w"])
    ranks = sorted(r.rank for r in rows if r.rank is not None)
    able = [r for r in rows if r.n_words >= 20]
    assert ranks == list(range(1, 25 * len(able) // 100 + 1))
    top = sorted(able, key=lambda r: -r.score)[: len(ranks)]
    assert sorted(r.score for r in rows if r.rank) == sorted(r.score for r in top)
    for r in rows:
        assert not r.n_words or r.n_features == 2 * r.n_words - 1
        assert r.n_words or (r.weight, r.rank, r.n_features) == (0, None, 0)
    assert {r.n_features for r in rows if r.doc_id == 7} == {want[7][0]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(none, items).collect() == []
    (row,) = R.resample(some, items).collect()
    assert got([row]) == brute([(1, "a b c " * 10)], [])
