"""Packing: every piece once, gapless, near the least number of sequences; ids equal the tokenizer's."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pageloom.llm.packing import pack, pack_documents, place, sequences, token_pieces
from pageloom.llm.tokens import run_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
ODD = ["", "J̌oo’s don't ÎİIi ΣΑΣ", "a<|endoftext|>b", "é \x1cz 12,345.67 ½ ⅷ 漢字kana ﬁ", "K Å Ω _x_", " \n\t"]


def whole(text):
    return run_ids(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("text", ODD)
def test_ids(text):
    assert np.frombuffer(run_ids(PATH).ids(text), "<u4").tolist() == whole(text)[:-1]


def check(rows, docs, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    want = []
    for ident, text in docs:
        ids = whole(text)
        for i, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a : a + capacity]
            want.append((ident, i, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    least = math.ceil(sum(w[3] for w in want) / capacity)
    assert len(at) <= least * 1.01 + 2


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)
    check(pack_documents(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, ODD[3]), (3, ODD[3]), (8, "word " * 50)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, group int, piece int")
    check(pack_documents(df, PATH, 16).collect(), docs, 16)


def test_sequences(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(30)], "doc_id long, text string")
    pieces = token_pieces(docs, PATH, 64, with_ids=True)
    made = sequences(pack(pieces, 64)).collect()
    assert sorted(x for r in made for x in r.ids) == sorted(x for i in range(30) for x in whole("some words " * i))


def test_least_sum_of_squares():
    """Each step of the rule against all choices."""
    random.seed(1)
    lengths = np.array(sorted((random.randrange(1, 20) for _ in range(60)), reverse=True))
    sequence, offset = place(lengths, 20)
    gaps = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
        def score(g):
            left = dict(gaps)
            left[g] = gaps[g] - n
            counts = defaultdict(int)
            for x in left.values():
                counts[x] += x > 0
            return sum(c * c for c in counts.values())

        fits = [g for g in gaps if gaps[g] >= n]
        if fits:
            assert s in gaps and score(s) == min(map(score, fits))
        else:
            assert s not in gaps
            gaps[s] = 20
        assert o == 20 - gaps[s]
        gaps[s] -= n


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
