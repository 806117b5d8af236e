"""Near duplicates against brute force over all pairs."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pageloom.llm import near as N
from pageloom.llm.near import near_duplicates

SMALL = "/root/testdata/sf0.001"


def probability_jaccard(x, y):
    """Of two weighted sets, by its definition."""
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))


def brute(rows, similarity=0.8):
    """Classes of texts that are near as sets or as weighted sets of shingles."""

    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        n = min(5, len(words))
        return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()

    sets = {}
    for ident, text in rows:
        sets.setdefault(ident, shingles(text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x.keys() & y.keys())
        if not both or find(a) == find(b):
            continue
        near = both >= similarity * len(x.keys() | y.keys())
        if near or (max(*x.values(), *y.values()) > 1 and probability_jaccard(x, y) >= similarity - 1e-9):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in sets}


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(400)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert classes(near_duplicates(docs)) == brute(rows)


@pytest.fixture(scope="module")
def chain():
    """Each text differs from the next in a few words, so only neighbours are near; and unlike texts."""
    random.seed(3)
    words = [f"w{random.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[random.randrange(300)] = f"x{random.randrange(10**6)}"
    for i in range(40, 60):
        rows.append((i, " ".join(f"y{random.randrange(10**6)}" for _ in range(100))))
    return rows


def test_chain_of_near_copies(spark, chain):
    df = spark.createDataFrame(chain, "doc_id long, text string").repartition(5)
    assert classes(near_duplicates(df)) == brute(chain)


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "one two"), (6, "one  two"), (7, "one two three")]
    rows += [(8, "a b c d e f"), (8, "a b c d e f"), (9, "a b c d e f"), (None, "z y x w v u"), (11, "z y x w v u")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, id int, key int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    want = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (8, 8), (9, 8), (None, None), (11, None)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0


def test_common_passage(spark):
    """Texts with a passage in common, alike but not enough, share many buckets; a few of them are near."""
    random.seed(5)
    passage = " ".join(f"p{i}" for i in range(110))
    rows = [(i, passage + " " + " ".join(f"u{random.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    rows += [(100 + i, rows[i * 7][1].rsplit(" ", 1)[0] + " z") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len(set(want.values())) == 60
    assert classes(near_duplicates(df)) == want


def test_lines_repeated_unequally_often(spark):
    """Texts near as sets are linked however often a line is repeated."""
    random.seed(11)
    rows = []
    for i in range(30):
        prose = " ".join(f"p{random.randrange(10**6)}" for _ in range(104))
        line = " ".join(f"l{random.randrange(10**6)}" for _ in range(20))
        rows += [(2 * i, prose), (2 * i + 1, " ".join([prose, *[line] * 200]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len(set(want.values())) == 30
    assert classes(near_duplicates(df)) == want


def test_probability_jaccard():
    rng = random.Random(1)
    for _ in range(60):
        x = Counter({k: rng.randint(1, 4) for k in rng.sample(range(30), rng.randint(1, 20))})
        y = Counter({k: rng.randint(1, 4) for k in rng.sample(range(30), rng.randint(1, 20))})
        both = sorted(x.keys() & y.keys())
        got = N.probability_jaccard(np.array([x[k] for k in both]), np.array([y[k] for k in both]), sum(x.values()), sum(y.values()))
        assert got == pytest.approx(probability_jaccard(x, y))


def test_sketches_agree_as_often_as_the_measure_says():
    """Share of equal places over many pairs of weighted sets."""
    rng = np.random.default_rng(2)
    x = {k: int(rng.integers(1, 9)) for k in range(40)}
    y = {k: (x[k] if k % 3 else int(rng.integers(1, 9))) for k in range(8, 44) if k < 40} | {k: 2 for k in range(40, 44)}
    agreed = total = 0
    for turn in range(300):
        names = N.mix(np.arange(44, dtype=np.uint64) + np.uint64(1000 * turn + 1))
        owner = np.array([0] * len(x) + [1] * len(y))
        keys = [*x, *y]
        weight = np.array([*x.values(), *y.values()], float)
        a, b = N.sketch(owner, names[keys], weight, 2, 96)
        agreed, total = agreed + int((a == b).sum()), total + 96
    assert agreed / total == pytest.approx(probability_jaccard(Counter(x), Counter(y)), abs=0.02)


def test_near_as_weighted_sets_only(spark):
    """A line repeated equally often outweighs prose that differs."""
    random.seed(12)
    rows = []
    for i in range(20):
        line = " ".join(f"l{random.randrange(10**6)}" for _ in range(20))
        rows += [(2 * i + k, " ".join([line] * 40 + [f"q{random.randrange(10**6)}" for _ in range(30)])) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len(set(want.values())) == 20
    assert classes(near_duplicates(df)) == want


def test_blocks_join_what_waves_leave(spark, monkeypatch):
    """Blocks of a few texts, and waves that settle little, give the same classes."""
    monkeypatch.setattr(N, "BLOCK", 400)
    random.seed(9)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(70):
        own = passage[:]
        for _ in range(3):
            own[random.randrange(2, 150, 6)] = f"v{random.randrange(6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert 5 < len(set(want.values())) < 65
    assert classes(near_duplicates(df)) == want


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, text), (2, text + " end"), (3, text[: len(text) // 2]), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(near_duplicates(df)) == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_recall_on_given_documents(spark, folder):
    """All pairs near as sets, found by an inverted index over all shingles, lie in one class."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = classes(near_duplicates(docs))
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for r in docs.collect() if (w := (r.text or "").split())}
    holders = {}
    for i, own in sets.items():
        for k in own:
            holders.setdefault(k, []).append(i)
    common = Counter(p for ids in holders.values() for p in itertools.combinations(ids, 2))
    links = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 50
    assert all(got[a] == got[b] for a, b in links)
