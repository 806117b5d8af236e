"""Cross-entropy difference of documents under matched n-gram models.

A target model (counted on the target documents) and a background model (counted on all the others) share
order, smoothing and weights, so their losses compare word by word. Words and pairs of words are counted under their
full 64-bit hashes, however many there are. Both models share one vocabulary: all words of the documents,
counted. The probability of a word is a mixture of its pair, word and uniform estimates over it, so
the estimates of a model sum to one; where the word before was never seen, the pair's share goes
to the word.

A document's score is the mean over its words of (target loss - background loss), in nats: the lower, the
closer to the target. A target document is part of its model, as in the usual selection recipe.

Documents are dealt by hash into chunks of about ``CHUNK_BYTES`` of text. A chunk asks for each of its distinct words,
contexts and pairs once, with its own counts, in as many ranges of the hash as there are chunks; a range sums
what all chunks ask and answers each, with the number of distinct words in the range, from which every chunk
sums the size of the vocabulary; a chunk then scores its documents. So no word is hot, a task holds one chunk
or one range, and what is shuffled grows with the input. The driver sees the size of the text only. Rows that
share id and text share a chunk.

Words are runs without white space or ASCII punctuation, in lower case. Defined results: a document without
words has null losses and zero words; a null id is background; without target documents the target model is
uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.substrings import small
from pageloom.llm.toxicity import plain_words
from pageloom.llm.words import U, Words, mix, pieces
from pageloom.plans.session import materialise

PAIRS = 1 << 20  # distinct pairs in a chunk, about
CHUNK_BYTES = 16 * PAIRS
LEAST_CHUNKS = 64
PAIR_SHARE, WORD_SHARE = 0.4, 0.95
_TOTAL = U(0)  # the key of the number of all words
_KIND = U(3)  # the last bits of a key: word, word before, or pair
_WORD, _BEFORE, _PAIR = U(1), U(2), U(3)


def slots(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word, of the word before (0 at the start of a text) and of the pair."""
    own = w.hashes
    before = np.roll(own, 1)
    before[w.first[:-1][w.counts > 0]] = 0
    return own, before, mix(before * U(0xD6E8FEB86659FD93) + own + U(1))


def _keys(w: Words) -> np.ndarray:
    """Keys of the words, of the words before, and of the pairs, one after another."""
    own, before, pair = slots(w)
    return np.concatenate([own & ~_KIND | _WORD, before & ~_KIND | _BEFORE, pair & ~_KIND | _PAIR])


def _lower(w: Words) -> Words:
    return plain_words(w.data, w.offsets)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys``, sorted, and the sums of their columns of ``counts``."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(counts[:, order], at, axis=1) if len(at) else counts[:, :0]


def _chunk_counts(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a chunk and their counts in background and target documents."""
    keys, counts = [np.array([_TOTAL])], [np.zeros((2, 1), np.int64)]
    for batch, w in pieces(chunk.to_batches()):
        w = _lower(w)
        found, place = np.unique(_keys(w), return_inverse=True)
        side = batch.column("target").to_numpy(zero_copy_only=False)[w.owner()]
        good = np.bincount(place[np.tile(side, 3)], minlength=len(found))
        keys.append(found)
        counts.append(np.stack([np.bincount(place, minlength=len(found)) - good, good]))
        counts[0] += np.array([[len(side) - side.sum()], [side.sum()]])
    return _summed(np.concatenate(keys), np.concatenate(counts, axis=1))


def _packed(values: np.ndarray) -> bytes:
    """64-bit values in few bytes: their first bytes, their second bytes and so on, compressed."""
    return pa.compress(values.reshape(-1, 1).view(np.uint8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _asked(parts: int):
    def run(chunk: pa.Table) -> pa.Table:
        keys, counts = _chunk_counts(chunk)
        cuts = np.searchsorted((keys >> U(32)) * U(parts) >> U(32), np.arange(parts + 1))
        asked = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if len(keys) > 1]
        return pa.table(
            {
                "part": pa.array([i for i, _, _ in asked], pa.int32()),
                "chunk": pa.array(np.full(len(asked), chunk.column("chunk")[0].as_py()), pa.int32()),
                "n": pa.array([b - a for _, a, b in asked], pa.int32()),
                # sorted keys as differences
                "keys": pa.array([_packed(np.diff(keys[a:b], prepend=U(0))) for _, a, b in asked], pa.binary()),
                "counts": pa.array([_packed(counts[:, a:b]) for _, a, b in asked], pa.binary()),
            }
        )

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """The sums over all chunks for the keys that each chunk asked for, and the number of words among all keys."""
    sizes = asked.column("n").to_pylist()
    keys = [np.cumsum(_unpacked(x, n, U)) for x, n in zip(asked.column("keys").to_pylist(), sizes)]
    counts = [_unpacked(x, 2 * n, np.int64).reshape(2, n) for x, n in zip(asked.column("counts").to_pylist(), sizes)]
    found, sums = _summed(np.concatenate(keys), np.concatenate(counts, axis=1))
    answers = pa.array([_packed(sums[:, np.searchsorted(found, x)]) for x in keys], pa.binary())
    words = np.full(len(keys), (found & _KIND == _WORD).sum(), np.int64)
    return asked.select(["chunk", "part", "n"]).append_column("sums", answers).append_column("words", pa.array(words))


def _losses(sums: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """Loss of each word, of the counts of the words, the words before and the pairs."""
    words, seen, pairs = sums.reshape(3, -1)
    single = WORD_SHARE * words / max(float(total), 1.0) + (1 - WORD_SHARE if total else 1.0) / vocabulary
    share = np.where(seen > 0, PAIR_SHARE, 0.0)
    return -np.log(share * (pairs / np.maximum(seen, 1)) + (1 - share) * single)


def _scores(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    keys, _ = _chunk_counts(chunk)
    sums = [np.zeros((2, 0), np.int64)]
    vocabulary = sum(answers.column("words").to_pylist())  # a chunk with words asks every range
    for x in answers.sort_by("part").to_pylist():
        sums.append(_unpacked(x["sums"], 2 * x["n"], np.int64).reshape(2, -1))
    sums = np.concatenate(sums, axis=1)
    if sums.shape[1] != len(keys) and len(keys) > 1:
        raise ValueError("a chunk changed between counting and scoring")
    out = []
    for batch, w in pieces(chunk.to_batches()):
        w = _lower(w)
        at = np.searchsorted(keys, _keys(w))
        some = w.counts > 0
        means = []
        for model in (1, 0):
            losses = _losses(sums[model, at], sums[model, 0], vocabulary) if some.any() else np.zeros(0)
            ends = np.append(0.0, np.cumsum(losses))
            mean = (ends[w.first[1:]] - ends[w.first[:-1]]) / np.maximum(w.counts, 1)
            means.append(pa.array(mean, mask=~some))
        columns = [batch.column("id"), pa.array(w.counts, pa.int64()), *means]
        out.append(pa.RecordBatch.from_arrays(columns, ["id", "n_words", "target_loss", "background_loss"]))
    return pa.Table.from_batches(out)


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_words, target_loss, background_loss, difference)``; ``targets`` holds ids of target documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = targets.select(F.col(id_col).cast("long").alias("id")).dropna().distinct().withColumn("mark", F.lit(True))
    marked = rows.join(small(materialise(marks)), "id", "left")
    parts = max(LEAST_CHUNKS, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")
    dealt = marked.select(chunk.alias("chunk"), "id", "text", F.coalesce("mark", F.lit(False)).alias("target"))
    # both uses of the chunks read one shuffle of the texts
    kinds = "part int, chunk int, n int, keys binary, counts binary"
    asked = dealt.groupBy("chunk").applyInArrow(_asked(parts), kinds)
    answers = asked.groupBy("part").applyInArrow(_answered, "chunk int, part int, n int, sums binary, words long")
    out = (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_scores, "id long, n_words long, target_loss double, background_loss double")
    )
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("id", id_col)
