"""Cross-entropy difference against a plain twin that counts the same slots."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pageloom.llm.lm_score import PAIR_SHARE, WORD_SHARE, score, slots
from pageloom.llm.toxicity import plain_words

ROWS = [
    (1, "the red fox, the red fox and the dog"), (2, "the red dog"), (3, "a blue whale sings a blue song"),
    (4, None), (5, ""), (6, "Whale! whale"), (2, "the red dog"), (None, "the red fox"),
]


def twin(rows, targets):
    texts = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
    at = [slots(plain_words(t, np.array([0, len(t)]))) for t in texts]
    counts = {True: [Counter(), Counter(), Counter()], False: [Counter(), Counter(), Counter()]}
    for (ident, _), found in zip(rows, at):
        for counter, values in zip(counts[ident in targets], found):
            counter.update(values.tolist())
    size = len(counts[True][0] | counts[False][0])
    out = []
    for (ident, _), (own, before, pair) in zip(rows, at):
        losses = []
        for kind in (True, False):
            words, contexts, pairs = counts[kind]
            n = sum(words.values())
            loss = 0.0
            for w, v, p in zip(own.tolist(), before.tolist(), pair.tolist()):
                single = WORD_SHARE * words[w] / n + (1 - WORD_SHARE) / size if n else 1 / size
                c = contexts[v]
                loss -= math.log(PAIR_SHARE * min(pairs[p], c) / c + (1 - PAIR_SHARE) * single if c else single)
            losses.append(loss / len(own) if len(own) else None)
        out.append((ident, len(own), *losses))
    return out


@pytest.mark.parametrize("targets", [{1, 2}, set(), {9}])
def test_twin(spark, targets):
    docs = spark.createDataFrame([(*r, 0, 0) for r in ROWS], "doc_id long, text string, slot int, target int").repartition(3)
    good = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    got = sorted(map(tuple, score(docs, good).select("doc_id", "n_words", "target_loss", "background_loss").collect()), key=repr)
    want = sorted(twin(ROWS, targets), key=lambda r: repr(r[:2]))
    assert [g[:2] for g in sorted(got, key=lambda r: repr(r[:2]))] == [w[:2] for w in want]
    for g, w in zip(sorted(got, key=lambda r: repr(r[:2])), want):
        assert g[2:] == (None, None) if w[2] is None else g[2:] == pytest.approx(w[2:])


def test_direction(spark):
    docs = spark.createDataFrame(
        [(i, "good words here " * 5 if i % 2 else "other things there " * 5) for i in range(20)], "doc_id long, text string"
    )
    good = docs.filter("doc_id % 2 = 1 AND doc_id < 15")
    for r in score(docs, good).collect():
        assert (r.difference < 0) == (r.doc_id % 2 == 1)


def test_losses_are_a_distribution(spark):
    """After a word both models have seen, the probabilities of all words of the shared vocabulary sum to one."""
    base = [(1, "a b a c"), (2, "a d é"), (3, "f")]
    words = ["a", "b", "c", "d", "é", "f"]
    probes = [(10 + i, w) for i, w in enumerate(words)]
    docs = spark.createDataFrame(base + probes, "doc_id long, text string")
    got = {r.doc_id: r for r in score(docs, docs.filter("doc_id = 1").select("doc_id")).collect()}
    for loss in ("target_loss", "background_loss"):
        assert sum(math.exp(-got[i][loss]) for i, _ in probes) == pytest.approx(1.0)


def test_very_long_text(spark):
    rows = [(1, "red fox " * 400_000), (2, "red fox"), (None, None)]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got[1].n_words == 800_000 and got[1].difference < 0 and got[None].target_loss is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score(docs, docs).count() == 0


def brute(rows, targets):
    """Losses by counting the words and pairs themselves."""
    counts = {kind: (Counter(), Counter(), Counter()) for kind in (True, False)}
    listed = [(i, re.findall(r"[a-z0-9]+", (t or "").lower())) for i, t in rows]
    for i, words in listed:
        before = [None, *words[:-1]][: len(words)]
        for counter, values in zip(counts[i in targets], (words, before, zip(before, words))):
            counter.update(values)
    size, out = len(counts[True][0] | counts[False][0]), {}
    for i, words in listed:
        losses = []
        for kind in (True, False):
            single, seen, pairs = counts[kind]
            n, loss = single.total(), 0.0
            for v, w in zip([None, *words], words):
                p = WORD_SHARE * single[w] / n + (1 - WORD_SHARE) / size
                loss -= math.log(PAIR_SHARE * pairs[v, w] / seen[v] + (1 - PAIR_SHARE) * p if seen[v] else p)
            losses.append(loss / len(words))
        out[i] = losses
    return out


def test_more_words_than_any_table_of_slots(spark):
    """Words and pairs are told apart however many there are: each text has rare words of its own."""
    random.seed(7)
    common = [f"c{i}" for i in range(50)]
    rows = []
    for i in range(400):
        own = [f"w{i}x{j}" for j in range(400)]
        rows.append((i, " ".join(w for pair in zip(own, random.choices(common, k=400)) for w in pair)))
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    targets = set(range(0, 400, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, targets)
    got = score(docs, docs.filter("doc_id < 400 AND doc_id % 3 = 0").select("doc_id")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], rel=1e-9)


def test_real_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text.isascii() and re.search("[A-Za-z0-9]", r.text)]
    rows = [(i, re.sub(r"[^A-Za-z0-9]+", " ", t)) for i, t in rows]
    targets = {i for i, _ in rows if i % 5 == 0}
    want = brute(rows, targets)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in score(df, df.filter("doc_id % 5 = 0").select("doc_id")).collect():
        assert (r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], rel=1e-9)
