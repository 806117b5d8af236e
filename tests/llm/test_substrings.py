"""Substring removal against brute force on odd and given texts."""

import random
import re

import pytest
from pageloom.llm.substrings import dedup_substrings

SMALL = "/root/testdata/sf0.001"


def brute(rows, window):
    """Kept words of each row; rows sharing an id are one document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [-(1 << 63) if i is None else i for i, _ in rows]
    first = {}
    for k, w in zip(key, words):
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            first[x] = min(first.get(x, (k, s)), (k, s))
    out = []
    for (ident, text), k, w in zip(rows, key, words):
        gone = {
            s + i for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (k, s) for i in range(window)
        }
        out.append((ident, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def kept(docs, window):
    got = dedup_substrings(docs, window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr)


@pytest.mark.parametrize("window, seed", [(4, 0), (5, 1), (6, 2)])
def test_random_texts(spark, window, seed):
    random.seed(seed)
    passages = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 15))) for _ in range(12)]
    rows = [(i, " \n".join(random.choice(passages) for _ in range(random.randrange(6)))) for i in random.sample(range(200), 80)]
    rows += [(None, "a b c d e f g h"), (1000, None), (1001, ""), (1002, "x " * 30), (1003, "x " * 9)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h int, id int").repartition(5)
    assert kept(df, window) == brute(rows, window)


def test_repeated_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (2, text + " z"), (2, text + " z"), (3, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df, 20) == brute(rows, 20)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept(docs, 20) == brute(rows, 20)


def test_cut_keeps_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"one\n{passage}\ttwo"), (2, f"three \n{passage}\n\nfour  five "), (3, None), (4, passage)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept_text, r.carried.lang) for r in dedup_substrings(df, joined=False, carry=("lang",)).collect()}
    assert got == {1: (rows[0][1], "k"), 2: ("three \nfour  five ", "k"), 3: (None, "k"), 4: ("", "k")}


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
