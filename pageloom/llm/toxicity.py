"""Toxic spans by a linear-chain conditional random field over words.

Fitting uses at most ``TOXIC_DOCS`` toxic and ``CLEAN_DOCS`` clean labelled documents (those with the least
hash of their id; of rows sharing an id the least text), whole texts of at most ``SAMPLE_TEXT_BYTES``, so the model and
the cost of fitting have a fixed bound; scoring covers every document and every word.

1. *Labelled tokens.* Labels are per document, so words are labelled by a greedy cover: the word or word
   beginning that explains most toxic documents not explained ``COVERS`` times yet, and occurs in at most
   ``NOISE`` of the clean ones, marks its tokens; then the next, while it explains ``SUPPORT`` documents or more.
   Near copies count as one document.
2. *Chain.* Two states (clean, toxic), transition weights, and hashed features of a word: itself, its
   beginnings of 3 to 8 bytes, its ending, the words beside it. Conditional likelihood is climbed by
   adaptive gradient steps; expected counts come from forward-backward.
3. *Scores.* Marginals of all words give the document score: a logistic function of the largest marginal, the
   second largest and the logarithm of the sum of squares, fitted on the same documents. Its intercept is held to the
   share of toxic ones and to ``NO_EVIDENCE``, so a text without evidence is never rejected. Runs of words with a
   marginal of at least ``span_at`` are the offending spans, with offsets in code points.

Words are runs without white space or ASCII punctuation, in lower case (ASCII and Latin-1). Only the text
enters a score. Defined results: null and empty texts get the score of no evidence and no spans; without
toxic or without clean training documents, and where the fitted scores do not tell the training documents apart
(toxic ones reach the threshold no more than twice as often as clean ones), every score is the share of toxic
ones (0 if there are none), at most ``NO_EVIDENCE``: few labels reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from pageloom.llm.words import PIECE_BYTES, U, Words, find_words, mix, released, texts_of, windows

TOXIC_DOCS, CLEAN_DOCS = 1000, 1500
NOISE, SUPPORT, COVERS = 0.002, 3, 3
SLOTS = 1 << 18
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
STEPS, RATE, DECAY = 25, 0.5, 1e-6
CHUNK = 200_000
THRESHOLD = 0.3
#: A text without any marked word scores at most this, below the threshold whatever the labels are.
NO_EVIDENCE = 0.2
#: Longer texts are not fitted on, which bounds the sample in bytes as well: (TOXIC_DOCS + CLEAN_DOCS) times this.
SAMPLE_TEXT_BYTES = 1 << 17

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


@dataclass
class Tagger:
    """Fitted weights; ``weights`` is None where there was nothing to learn from."""

    prior: float = 0.0
    weights: np.ndarray | None = None
    bias: float = 0.0
    chain: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.zeros(4))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    out = _PLAIN[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[upper] += 0x20
    return find_words(out, offsets)


def parts(w: Words) -> list[np.ndarray]:
    """64-bit hashes of a word, its beginnings (0 where it is shorter) and its ending."""
    length = w.ends - w.starts
    out, h = [w.hashes], np.zeros(len(length), U)
    last = max(len(w.data) - 1, 0)
    for k in range(1, BEGINNINGS[-1] + 1):
        h = h * U(0x100000001B3) + w.data[np.minimum(w.starts + k - 1, last)].astype(U) + U(1)
        if k in BEGINNINGS:
            out.append(np.where(length >= k, mix(h + U(k << 56)), U(0)))
    h = np.zeros(len(length), U)
    for k in (1, 2, 3):
        h = h * U(0x100000001B3) + w.data[np.maximum(w.ends - k, 0)].astype(U) + U(1)
    out.append(mix(h + U(77 << 56)))
    return out


def features(w: Words) -> np.ndarray:
    """Feature slots of each word, one row per feature."""
    own = parts(w)
    before, after = np.roll(w.hashes, 1), np.roll(w.hashes, -1)
    first = w.first[:-1][w.counts > 0]
    before[first] = 1
    after[np.append(first[1:], len(after))[: len(first)] - 1] = 1
    rows = (*own, mix(before + U(3)), mix(after + U(5)))
    return np.stack([((r >> U(20)) % U(SLOTS)).astype(np.int32) for r in rows])


def emission(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    out = np.zeros(slots.shape[1])
    for row in slots:
        out += weights[row]
    return out


def marginals(score: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of two-state chains laid end to end; ``first``: where each chain begins.

    Returns the probability of state 1 at each place and the expected 0-0, 0-1, 1-0, 1-1 steps summed.
    A chain's first place forgets the state before it. The places are cut into rows of equal length that
    run side by side; a first pass multiplies each row's steps, so the rows join exactly.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    width = max(1, int(np.sqrt(n)))
    height = -(-n // width)
    a = np.exp(chain)
    e = np.ones(height * width)
    e[:n] = np.exp(np.clip(score, -30, 30))
    head = np.zeros(height * width, bool)
    head[first[first < n]] = True
    head[n:] = True
    e, head = e.reshape(height, width).T, head.reshape(height, width).T
    # step t: m[i][j] = a[i][j] e_j, or e_j at the head of a chain
    step = [[np.where(head, 1.0, a[i, 0]) for i in (0, 1)], [np.where(head, 1.0, a[i, 1]) * e for i in (0, 1)]]
    p = [[np.ones(height), np.zeros(height)], [np.zeros(height), np.ones(height)]]
    for t in range(width):
        for i in (0, 1):
            x, y = p[i]
            p[i] = [x * step[0][0][t] + y * step[0][1][t], x * step[1][0][t] + y * step[1][1][t]]
        norm = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[q / norm for q in row] for row in p]
    into = np.empty((height, 2))  # forward state before each row
    out = np.empty((height, 2))  # backward state after each row
    f = b = np.array([0.5, 0.5])
    whole = np.array(p).transpose(2, 0, 1)
    for r in range(height):
        into[r] = f
        f = f @ whole[r]
        f = f / f.sum()
        out[height - 1 - r] = b
        b = whole[height - 1 - r] @ b
        b = b / b.sum()
    forward, backward = np.empty((2, width, height)), np.empty((2, width, height))
    f0, f1 = into.T
    for t in range(width):
        f0, f1 = f0 * step[0][0][t] + f1 * step[0][1][t], f0 * step[1][0][t] + f1 * step[1][1][t]
        norm = f0 + f1
        f0, f1 = f0 / norm, f1 / norm
        forward[0, t], forward[1, t] = f0, f1
    b0, b1 = out.T
    for t in range(width - 1, -1, -1):
        backward[0, t], backward[1, t] = b0, b1
        c0, c1 = b0, b1
        b0 = step[0][0][t] * c0 + step[1][0][t] * c1
        b1 = step[0][1][t] * c0 + step[1][1][t] * c1
        norm = b0 + b1
        b0, b1 = b0 / norm, b1 / norm
    f, b = forward.transpose(0, 2, 1).reshape(2, -1)[:, :n], backward.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    at = f * b
    one = at[1] / (at[0] + at[1])
    inner = np.ones(n, bool)
    inner[first[first < n]] = False
    inner = np.flatnonzero(inner)
    flat = e.T.reshape(-1)[:n]
    pair = np.empty((2, 2, len(inner)))
    for i in (0, 1):
        for j in (0, 1):
            pair[i, j] = f[i, inner - 1] * a[i, j] * (flat[inner] if j else 1.0) * b[j, inner]
    return one, (pair / pair.sum((0, 1))).sum(2)


def summary(p: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text: 1, the two largest marginals, the logarithm of one plus the sum of their squares."""
    out = np.zeros((len(counts), 4))
    out[:, 0] = 1
    some = np.flatnonzero(counts)
    if len(some):
        cuts = first[some]
        top = np.maximum.reduceat(p, cuts)
        owner = np.repeat(np.arange(len(some)), counts[some])
        place = np.flatnonzero(p == top[owner])
        _, one = np.unique(owner[place], return_index=True)
        rest = p.copy()
        rest[place[one]] = 0
        out[some, 1], out[some, 2] = top, np.maximum.reduceat(rest, cuts)
        out[some, 3] = np.log1p(np.add.reduceat(p * p, cuts))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def copy_groups(w: Words) -> np.ndarray:
    """For each text, the first text that shares its least hash of five words; near copies mostly do."""
    n = len(w.first) - 1
    least = np.arange(n).astype(U)
    some = np.flatnonzero(w.counts)
    if len(some):
        value = np.where(w.room() >= 5, windows(w.hashes, 5), ~U(0))
        least[some] = np.minimum.reduceat(value, w.first[some])
        least[some] = np.where(w.counts[some] < 5, w.hashes[w.first[some]] ^ some.astype(U), least[some])
    _, first, number = np.unique(least, return_index=True, return_inverse=True)
    return first[number]


def token_labels(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic texts that the greedy cover marks."""
    owner = w.owner()
    group = copy_groups(w)  # copies of a text explain nothing more than the text
    bad, n = toxic[owner], len(toxic)
    names, lengths, numbers, docs, known = [], [], [], [], 0
    for k, value in enumerate(parts(w)[:-1]):
        own = np.flatnonzero(bad & (value != 0))
        name, number = np.unique(value[own], return_inverse=True)
        at = np.minimum(np.searchsorted(name, value[~bad]), max(len(name) - 1, 0))
        met = np.flatnonzero(name[at] == value[~bad]) if len(name) else at
        clean = np.unique(at[met] * n + group[owner[~bad][met]]) // n
        usable = np.bincount(clean, minlength=len(name)) <= NOISE * (~toxic).sum()
        pairs = np.unique(number * n + group[owner[own]])
        pairs = pairs[usable[pairs // n]]
        names.append(name)
        # of equal covers the longest part wins: the word before its beginnings
        lengths.append(np.full(len(name), k or len(BEGINNINGS) + 1))
        numbers.append(pairs // n + known)
        docs.append(pairs % n)
        known += len(name)
    names, length, number, doc = (np.concatenate(x) for x in (names, lengths, numbers, docs))
    marks: list[int] = []
    wanted = np.full(n, COVERS)
    while len(number):
        cover = np.bincount(number, minlength=len(names))
        ties = np.flatnonzero(cover == cover.max())
        best = int(ties[np.argmax(length[ties])])
        if cover[best] < SUPPORT:
            break
        marks.append(best)
        wanted[doc[number == best]] -= 1
        left = (wanted[doc] > 0) & (number != best)
        number, doc = number[left], doc[left]
    marked = np.zeros(len(owner), bool)
    for value in parts(w)[:-1] if marks else ():
        marked |= np.isin(value, names[marks])
    return marked & bad


def fit(texts: pa.Array, toxic: np.ndarray) -> Tagger:
    """Fit on labelled texts (at most the documented bound)."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Tagger(min(float(toxic.mean()), NO_EVIDENCE) if len(toxic) else 0.0)
    prior = min(float(toxic.mean()), NO_EVIDENCE)
    w = plain_words(*texts_of(texts))
    if not len(w.hashes):
        return Tagger(prior)
    gold = token_labels(w, toxic).astype(np.float64)
    slots = features(w)
    first = w.first[:-1][w.counts > 0]
    # texts of about CHUNK words at a time, so a step's temporary arrays stay small
    cuts = [0, *first[np.flatnonzero(np.diff(first // CHUNK)) + 1].tolist(), len(gold)]
    chunks = [(a, b, first[(first >= a) & (first < b)] - a) for a, b in zip(cuts[:-1], cuts[1:])]
    inner = np.ones(len(gold), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[inner - 1].astype(int), gold[inner].astype(int)), 1)
    weights, chain, bias = np.zeros(SLOTS), np.zeros((2, 2)), np.log(max(gold.mean(), 1e-6))
    speed_w, speed_c, speed_b = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    p = np.empty(len(gold))
    for step in range(STEPS + 1):
        steps = np.zeros((2, 2))
        for a, b, heads in chunks:
            p[a:b], part = marginals(bias + emission(weights, slots[:, a:b]), heads, chain)
            steps += part
        if step == STEPS:
            break
        diff = gold - p
        grad = -DECAY * len(gold) * weights
        for row in slots:
            grad += np.bincount(row, diff, SLOTS)
        speed_w += grad**2
        weights += RATE * grad / np.sqrt(speed_w)
        turn = seen - steps
        speed_c += turn**2
        chain += RATE * turn / np.sqrt(speed_c)
        speed_b += diff.sum() ** 2
        bias += RATE * diff.sum() / np.sqrt(speed_b)
    tagger = Tagger(prior, weights.astype(np.float32), float(bias), chain)
    x = summary(p, w.first[:-1], w.counts)
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    coef = np.zeros(4)
    for _ in range(50):  # Newton steps of a ridge logistic fit, classes weighing the same
        q = _sigmoid(x @ coef)
        h = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(4)
        coef += np.linalg.solve(h, x.T @ (share * (toxic - q)) - 1e-3 * coef)
    coef[0] = min(coef[0], np.log(prior / (1 - prior)))
    hit = _sigmoid(x @ coef) >= THRESHOLD
    if hit[toxic].mean() <= 2 * hit[~toxic].mean():
        return Tagger(prior)
    tagger.score = coef
    return tagger


def fit_tagger(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fit on rows of ``labels`` ``(<id_col>, toxic)``: only those with ``crc32(id) mod 4`` other than 2."""
    ids = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .filter("crc32(cast(id AS string)) % 4 <> 2")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    turn = F.xxhash64(F.lit(5), "id")
    some = [
        ids.filter(F.col("toxic") == kind).orderBy(turn, "id").limit(n) for kind, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))
    ]
    chosen = some[0].unionByName(some[1])  # at most TOXIC_DOCS + CLEAN_DOCS rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(chosen), "id")
    one = texts.groupBy("id", "toxic").agg(F.min("text").alias("text"))  # a repeated id is one document
    sample = one.select("id", "text", "toxic").toArrow().sort_by([("id", "ascending")])
    return fit(sample.column("text"), sample.column("toxic").to_numpy() == 1)


def _spans(w: Words, data: np.ndarray, p: np.ndarray, at: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    hot = np.flatnonzero(p >= at)
    if len(hot):
        owner = np.searchsorted(w.first, hot, "right") - 1
        cut = np.append(0, np.flatnonzero((np.diff(hot) > 1) | (np.diff(owner) > 0)) + 1)
        for a, b in zip(cut, np.append(cut[1:], len(hot))):
            doc = owner[a]
            base = w.offsets[doc]
            lead = data[base : w.ends[hot[b - 1]]]
            chars = np.cumsum((lead & 0xC0) != 0x80)
            start, stop = int(w.starts[hot[a]] - base), int(w.ends[hot[b - 1]] - base)
            out[doc].append(
                {
                    "start": int(chars[start - 1]) if start else 0,
                    "stop": int(chars[stop - 1]),
                    "probability": float(p[hot[a:b]].max()),
                }
            )
    return out


SPANS = "array<struct<start:int, stop:int, probability:double>>"


def _tag(tagger: Tagger, span_at: float):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = texts_of(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
                own = data[offsets[i] : offsets[j]]
                score, spans = _score(tagger, own, offsets[i : j + 1] - offsets[i], span_at)
                done = batch.slice(i, j - i)
                columns = [c for c in done.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(done.column(c) for c in columns), pa.array(score), pa.array(spans, kind)],
                    [*columns, "score", "spans"],
                )
                i = j

    return run


def _score(tagger: Tagger, data: np.ndarray, offsets: np.ndarray, span_at: float):
    n = len(offsets) - 1
    if tagger.weights is None:
        return np.full(n, tagger.prior), [[] for _ in range(n)]
    w = plain_words(data, offsets)
    score = tagger.bias + emission(tagger.weights, features(w)) if len(w.hashes) else np.zeros(0)
    p, _ = marginals(score, w.first[:-1][w.counts > 0], tagger.chain)
    return _sigmoid(summary(p, w.first[:-1], w.counts) @ tagger.score), _spans(w, data, p, span_at)


def score_toxicity(
    docs: DataFrame, tagger: Tagger, span_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(<id_col>, score, spans)``, one row per row of ``docs``; only the text enters a score."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_tag(tagger, span_at), f"id long, score double, spans {SPANS}")
    return out.withColumnRenamed("id", id_col)


def _clean(tagger: Tagger, threshold: float, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            batch = batch.select(columns)
            for part in _tag(tagger, 2.0)(iter([texts])):
                keep = part.column("score").to_numpy() < threshold
                yield batch.slice(0, part.num_rows).filter(pa.array(keep))
                batch = batch.slice(part.num_rows)

    return run


def without_toxic(docs: DataFrame, tagger: Tagger, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``threshold``; a row crosses to Python and back once."""
    text = docs.select(text_col).schema[0]
    rows, sent = docs, text.name
    if not isinstance(text.dataType, StringType):
        rows, sent = docs.withColumn("_text", F.col(text_col).cast("string")), "_text"
    return rows.mapInArrow(_clean(tagger, threshold, sent, docs.columns), docs.schema)
