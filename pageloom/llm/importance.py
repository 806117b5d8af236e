"""Target-distribution importance resampling over hashed word runs.

1. *Pre-tokenisation.* An untrained ``Split`` of the tokenizers library cuts the ASCII-lowered text by a pattern into
   words with offsets. Nothing is learned and there is no vocabulary.
2. *Features.* Windows over the offset pairs, of one up to ``order`` words, are hashed as their words joined by one
   space: the checksum of a longer run goes on from that of the shorter one, so a feature costs one call whatever
   its length. The bucket is the unsigned CRC-32 modulo ``buckets``.
3. *Histograms.* Each task counts its own buckets and passes on one row a bucket; all documents hold ``S`` features,
   ``s`` in a bucket, the target texts ``T`` and ``t``. A bucket's gain is
   ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``.
4. *Weights.* A document's weight is the floored mean of its features' gains (0 without features).
5. *Draw.* ``score = weight + floor(-1000 ln(-ln u))`` with ``u`` from a seeded hash of the id (Gumbel noise turns the
   highest scores into a draw without replacement in proportion to ``exp(weight / 1000)``). Of the ``N`` documents
   with at least ``least_words`` words the ``percent * N / 100`` (rounded down) highest are drawn; ties go to the
   smaller id.

Texts are pre-tokenised once; their buckets, two bytes a feature, are stored and read by the histogram and by the
weights. Only gains (one number a bucket), bucket counts and one row count per partition of the ranking meet the
driver. The ranking is a range sort of ids and scores, so no source or group of copies meets in one task.

Defined results: a null or empty text, and one without words, has no features, weight 0 and is never drawn if
``least_words`` is over 0; bytes that are no UTF-8 read as U+FFFD; a null id hashes as an empty one and sorts first;
rows sharing an id are documents of their own with the same noise, interchangeable where their scores tie. Texts
are cut between words every :data:`CUT` characters, which bounds what the library returns at once, not the result.
An empty table gives no rows; without target texts ``t = T = 0``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.shards import with_position
from pageloom.plans.session import materialise

BUCKETS = 10_000
ORDER = 2
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
CUT = 1 << 18
#: Words of the lowered text: digits, small letters and everything outside ASCII.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


@lru_cache(maxsize=1)
def _split():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), behavior="removed", invert=True).pre_tokenize_str


def words(text: str) -> list[bytes]:
    """Words of an ASCII-lowered text, in UTF-8."""
    out: list[bytes] = []
    i = 0
    while i < len(text):
        cut = _BETWEEN.search(text, i + CUT) if len(text) - i > CUT else None
        part = text[i : cut.start()] if cut else text[i:]
        out += [part[a:b].encode() for _, (a, b) in _split()(part)]
        i += max(len(part), 1)
    return out


def feature_buckets(text: bytes | None, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of one to ``order`` words."""
    found = words((text or b"").lower().decode("utf-8", "replace"))
    runs = list(map(crc32, found))
    out = [np.array(runs, np.int64)]
    for n in range(1, order):
        # the run of n words from i on, a space, and the word after it
        runs = [crc32(w, crc32(b" ", c)) for w, c in zip(found[n:], runs)]
        out.append(np.array(runs, np.int64))
    return len(found), (np.concatenate(out) % buckets).astype("<u2")


def _featured(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            got = [feature_buckets(x.as_py(), order, buckets) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([f.tobytes() for _, f in got], pa.binary()),
                ],
                ["id", "n_words", "features"],
            )

    return run


def _features_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("features")]


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in _features_of(batch):
                total += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def featured(docs: DataFrame, id_col: str, text_col: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``(id, n_words, features)`` of every row, stored; ``features`` are 16-bit buckets, so at most 65,536 of them."""
    if buckets > 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(_featured(order, buckets), "id long, n_words long, features binary"))


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: one row per task and bucket is shuffled, one per bucket reaches the driver."""
    counts = features.mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from both histograms."""
    n = len(source)
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in pairs], np.int64)


def _weighted(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _features_of(batch)
            weight = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("n_words"),
                    pa.array([len(f) for f in own], pa.int64()),
                    pa.array(weight, pa.int64()),
                ],
                ["id", "n_words", "n_features", "weight"],
            )

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    order: int = ORDER,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id: str = "item_id",
) -> DataFrame:
    """``(<id_col>, n_words, n_features, weight, score, rank)`` of every row of ``docs``; undrawn rows have no rank."""
    source = featured(docs, id_col, text_col, order, buckets)
    wanted = featured(target, target_id, text_col, order, buckets)
    gain = gains(histogram(source, buckets), histogram(wanted, buckets))
    weighted = source.mapInArrow(_weighted(gain), "id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    scored = materialise(weighted.withColumn("score", F.col("weight") + noise).withColumn("down", -F.col("score")))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.filter(able).count() // 100
    ranked = with_position(scored.filter(able), "down", "id")
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    rest = scored.filter(~able).withColumn("position", F.lit(None).cast("long"))
    out = ranked.unionByName(rest).withColumn("rank", rank.cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
