"""Forward-backward against enumeration; learning, spans and odd rows; held-out accuracy on given data."""

import itertools
import random

import numpy as np
from pageloom.llm.toxicity import Tagger, fit_tagger, marginals, score_toxicity, without_toxic


def test_marginals():
    rng = np.random.default_rng(0)
    for first, n in (([0], 1), ([0, 4], 9), ([0, 1, 2], 3), ([0, 3, 10], 11)):
        score, chain = rng.normal(size=n), rng.normal(size=(2, 2))
        p, steps = marginals(score, np.array(first), chain)
        want, pairs = np.zeros(n), np.zeros((2, 2))
        for a, b in zip(first, [*first[1:], n]):
            total, one, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=b - a):
                v = np.exp(sum(score[a + i] * y[i] for i in range(b - a)) + sum(chain[s] for s in zip(y, y[1:])))
                total += v
                one += v * np.array(y)
                for s in zip(y, y[1:]):
                    two[s] += v
            want[a:b] = one / total
            pairs += two / total
        assert np.allclose(p, want) and np.allclose(steps, pairs)


def corpus(n=400):
    random.seed(4)
    words = [f"w{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        text = random.choices(words, k=40)
        bad = i % 5 == 0
        if bad:
            text[random.randrange(40)] = random.choice(["Blörgfoo,", "blörgbar", "blörg", "Snarfy!"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_spans_and_beginnings(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    tagger = fit_tagger(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in score_toxicity(d, tagger).collect()}
    texts, toxic = dict(docs), dict(labels)
    assert all((got[i].score >= 0.3) == bool(toxic[i]) for i in toxic)
    for i in toxic:
        found = [texts[i][s.start : s.stop].lower() for s in got[i].spans]
        assert len(found) == toxic[i] and all(f.startswith(("blörg", "snarfy")) for f in found)
    new = [(1, "a new blörgzip"), (2, "quite clean"), (3, None), (4, ""), (None, "É blörg"), (1, "a new blörgzip"), (5, "w1 " * 50_000)]
    df = spark.createDataFrame([(*r, 0.5, 7) for r in new], "doc_id long, text string, score double, spans int")
    rows = score_toxicity(df, tagger).collect()
    assert sorted((r.doc_id, r.score >= 0.3) for r in rows if r.doc_id) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    assert [(s.start, s.stop) for r in rows if r.doc_id is None for s in r.spans] == [(2, 7)]
    left = without_toxic(df, tagger)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(2, None)]):
        tagger = fit_tagger(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in score_toxicity(d, tagger).collect()] == [0.0, 0.0]
    assert score_toxicity(d.limit(0), Tagger()).count() == 0


def test_few_or_useless_labels_reject_nothing(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rng = random.Random(6)
    for few in (
        [(0, 1)],
        [(0, 1), (1, 0)],
        [(i, 1) for i, _ in docs],
        [(i, rng.randint(0, 1)) for i, _ in docs if i % 5],
    ):
        tagger = fit_tagger(d, spark.createDataFrame(few, "doc_id long, toxic int"))
        assert without_toxic(d, tagger).count() >= 48
        assert all(0 <= r.score <= 1 for r in score_toxicity(d, tagger).collect())
    clean = spark.createDataFrame([(1, "w1 w2 w3"), (2, ""), (3, "unseen words only")], "doc_id long, text string")
    tagger = fit_tagger(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert without_toxic(clean, tagger).count() == 3


def test_repeated_and_very_long_labelled_rows(spark):
    docs, labels = corpus(200)
    more = docs + [docs[0]] * 500 + [(5, "long text " * 200_000)]
    d = spark.createDataFrame(more, "doc_id long, text string")
    tagger = fit_tagger(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = {r.doc_id for r in without_toxic(spark.createDataFrame(docs, "doc_id long, text string"), tagger).collect()}
    assert kept == {i for i, bad in labels if not bad}


def test_texts_are_sent_to_python_once(spark):
    docs = spark.createDataFrame([(1, "x y", "fr"), (2, None, None)], "doc_id long, text string, lang string")
    left = without_toxic(docs, Tagger(0.1))
    assert left.schema == docs.schema and sorted(left.collect()) == sorted(docs.collect())
    assert without_toxic(docs, Tagger(0.5)).count() == 0
    # into the Python stage and out of it, and nowhere beside a row that holds it too
    node = next(line for line in left._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line)
    assert node.count("text#") == 2 and "row#" not in node
    numbers = spark.createDataFrame([(1, 5)], "doc_id long, text int")
    assert [tuple(r) for r in without_toxic(numbers, Tagger(0.1)).collect()] == [(1, 5)]


def test_held_out_accuracy(spark):
    """Given data: few labels, and words of some languages are too rare to learn; clean ones stay clean."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("crc32(cast(doc_id AS string)) % 4 = 2")
    own = docs.join(held, "doc_id")
    scored = score_toxicity(own.select("doc_id", "text"), fit_tagger(docs, labels)).join(held, "doc_id")
    n = {(r.toxic, r.hit): r["count"] for r in scored.selectExpr("toxic", "score >= 0.3 AS hit").groupBy("toxic", "hit").count().collect()}
    assert n.get((1, True), 0) >= 0.85 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.01 * (n.get((0, True), 0) + n.get((0, False), 0))
