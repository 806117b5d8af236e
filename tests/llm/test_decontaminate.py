"""Benchmark items in documents: given data against brute force, planted cases, odd rows."""

import random
import re
from collections import Counter

import numpy as np
from pageloom.llm.decontaminate import COVERAGE, LITERALS, WINDOW, best_cover, contaminated, template

SMALL = "/root/testdata/sf0.001"

ITEM = (
    "Last week Anna bought 12 apples and 7 pears for 3.50 dollars at the old market near the river. "
    "How many apples does Anna have left after giving 5 apples to her friend Peter ?"
)
CHANGED = ITEM.replace("Anna", "Maria").replace("12", "45").replace("Peter", "Tom").replace("3.50", "9")
MIXED = ITEM.replace("Anna", "Maria", 1).replace("giving", "lending").replace("near the river", "by the sea")


def found(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, id string, item string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(docs, items).collect()}


def test_planted(spark):
    lead = "something else entirely. "
    docs = [(1, lead + ITEM), (2, lead + CHANGED + " and so on"), (3, ITEM.lower()), (4, lead * 9), (5, None), (6, "")]
    docs += [(7, ITEM.replace(" ", "\n").replace(".", " !!")), (None, ITEM)]
    got = found(spark, docs, [(10, ITEM), (11, None), (12, "too short"), (13, "")])
    assert set(got) == {(1, 10), (2, 10), (3, 10), (7, 10), (None, 10)}
    assert got[(1, 10)].coverage == 1.0 and got[(1, 10)].changed_slots == 0
    assert got[(2, 10)].coverage == 1.0 and got[(2, 10)].changed_slots == 4


def test_slots_must_agree(spark):
    item = "Take 3 red balls out of the box and put 4 blue balls into the box before you count all 3 red balls again"
    swapped = item.replace("3 red", "5 red", 1)
    got = found(spark, [(1, item.replace("3", "8")), (2, swapped)], [(1, item)])
    assert got[(1, 1)].coverage == 1.0
    assert (2, 1) not in got or got[(2, 1)].coverage < 1.0


def test_given_documents(spark):
    def words(t):
        return [w for w in (re.sub(r"\W+", "", x).lower() for x in (t or "").split()) if w]

    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = set()
    texts = [(r.doc_id, " " + " ".join(words(r.text)) + " ") for r in docs.collect()]
    for item in items.collect():
        form = " " + " ".join(words(item.text)) + " "
        want |= {(i, item.item_id) for i, t in texts if form in t}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).filter("coverage = 1").collect()}
    assert want <= got


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(empty, item).count() == 0
    assert contaminated(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), none).count() == 0


def tokens(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    w, codes, literal = template(data, np.array([0, len(data)]))
    return w.hashes.tolist(), codes.tolist(), literal.tolist()


def brute(docs, items):
    """Every window of every document against every window of every item."""
    out = Counter()
    for ident, text in docs:
        words, codes, _ = tokens(text)
        for item, question in items:
            own, forms, literal = tokens(question)
            n = len(own)
            if n < LITERALS:
                continue
            size = min(WINDOW, n)
            hits = []
            for p in range(len(words) - size + 1):
                for a in range(n - size + 1):
                    like = codes[p : p + size] == forms[a : a + size] and sum(literal[a : a + size]) >= LITERALS
                    if like or words[p : p + size] == own[a : a + size]:
                        hits.append((p, words[p : p + size], [a], own[a : a + size]))
            best, segment = (0.0, 0), []
            for hit in [*hits, None]:
                far = segment and hit and (hit[0] > segment[-1][0] + n or hit[0] > segment[0][0] + 4 * n)
                if segment and (hit is None or far):
                    share, changed = best_cover(segment, n)
                    best, segment = max(best, (share, -changed)), []
                if hit:
                    segment.append(hit)
            if best[0] >= COVERAGE:
                out[ident, item, round(best[0], 9), -best[1]] += 1
    return out


def test_brute_force(spark):
    random.seed(4)
    names, things = ("Anna", "Maria", "Tom", "Peter"), ("red balls", "blue boats", "apples", "pears")

    def sentence():
        n, m = random.randrange(2, 40), random.randrange(2, 40)
        one, thing = random.choice(names), random.choice(things)
        return f"Here is how {one} took {n} of the {thing} and then {m} more to the shop, so {one} has {n} {thing} now."

    items = [(i, " ".join(sentence() for _ in range(random.randrange(1, 3)))) for i in range(6)]
    items += [(7, "one small short item"), (8, "too short"), (9, None), (None, sentence()), (0, items[0][1]), (0, "an other text of five")]
    docs = [(i, " then ".join(sentence() for _ in range(random.randrange(1, 5)))) for i in range(25)]
    docs += [(30, items[0][1] * 3), (30, items[0][1] * 3), (None, items[1][1]), (31, "so one small short item here")]
    docs += [(32, items[2][1] + " and " + "filler word " * 300 + items[2][1].replace("the shop", "a house")), (33, None), (34, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.item_id, round(r.coverage, 9), r.changed_slots) for r in contaminated(a, b).collect())
    assert got == brute(docs, items)
    assert len(got) > 30


def test_lookalike_before_the_passage(spark):
    opening = " ".join(ITEM.split()[:12]).replace("Anna", "Maria").replace("12", "45")
    got = found(spark, [(1, opening + " but that is an other story. " + ITEM)], [(1, ITEM)])
    assert got[(1, 1)].coverage == 1.0


def test_two_slots_may_share_a_value(spark):
    same = ITEM.replace("12", "4").replace("7", "4")
    assert found(spark, [(1, same)], [(1, ITEM)])[(1, 1)].coverage == 1.0


def test_very_long_text(spark):
    long = "some filler text that says nothing. " * 100_000
    got = found(spark, [(1, long + ITEM + long), (2, (ITEM + " ") * 3000)], [(1, ITEM)])
    assert {k: v.coverage for k, v in got.items()} == {(1, 1): 1.0, (2, 1): 1.0}
