"""Shards: gapless slots, equal counts, the mixture of the whole, a plain Python twin."""

import zlib
from collections import Counter, defaultdict

import pytest
from pageloom.llm.shards import shard_documents
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def check(docs, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = shard_documents(docs, 4).collect()
    check(docs.collect(), rows, 4)
    whole = Counter(r.source for r in rows)
    for shard in range(4):
        own = Counter(r.source for r in rows if r.shard == shard)
        assert all(abs(own[s] - n / 4) <= 2 for s, n in whole.items())


def test_order_equals_plain_ranks(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i}", "hot" if i % 3 else f"s{i % 7}") for i in range(500)], "doc_id long, text string, source string"
    )
    rows = shard_documents(docs.repartition(7), 5, seed=3).collect()
    turns = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id", F.crc32("text"), (F.octet_length("text") + 1).cast("long")).alias("h")).collect()}
    source = {r.doc_id: r.source for r in rows}
    ranks = {}
    for s in set(source.values()):
        own = sorted((i for i in source if source[i] == s), key=lambda i: (turns[i], i))
        ranks |= {i: ((k + 0.5) / len(own), s) for k, i in enumerate(own)}
    want = sorted(source, key=lambda i: (*ranks[i], turns[i], i))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == want


@pytest.mark.parametrize("n", [0, 3])
def test_odd_rows(spark, n):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "é", None)] * n
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n int, position int")
    check(docs.collect(), shard_documents(docs).collect(), 16)
