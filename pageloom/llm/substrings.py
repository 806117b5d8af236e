"""Exact substring de-duplication over words by level-wise doubling.

A *window* is ``window`` consecutive words of one document. A word is removed if it lies in a window
whose word sequence also starts earlier: in a document with a smaller id, or earlier in the same one.
Windows are judged on the input, not on what is left.

Levels double from half the window to the window itself:

1. ``window / 2`` words. Only *anchors* travel: of all half windows inside one window, the one with the
   least hash (winnowing). Equal windows pick equal anchors, so every repeated window holds a repeated
   anchor, and about a sixth of the places are shuffled.
2. ``window`` words. Windows whose anchor is repeated are compared; later occurrences are removed.
   A maximal repeat is covered by its windows, so further doubling would remove nothing more.

Each task first settles repeats among its own rows and passes on one row per hash, so a passage in a
third of all documents sends one row per piece of input, not one per document. Partitions are then read in
sorted order with constant memory. Whole copies are settled before level 1 by their text digest.

Defined results: a null text has no words; a null id sorts before all ids; rows sharing an id are one
document (of windows at the same start neither is earlier, so repeated rows share one result).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.words import U, Words, mix, pieces, sliding, windows
from pageloom.plans.session import BROADCAST_LIMIT_BYTES, materialise, settle, size_in_bytes

WINDOW = 20
_NULL_ID = -(1 << 63)


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _anchor_places(w: Words, half: np.ndarray, window: int) -> np.ndarray:
    """Places of the words whose half window is the least of some window around it."""
    size = window - window // 2 + 1
    whole = w.room() >= window
    least = np.where(whole, sliding(half, size, np.minimum), U(0))
    back = sliding(least[::-1], size, np.maximum)[::-1]
    # the reversed slide wraps only onto void places: the first places of the batch see too much
    for i in range(min(size - 1, len(half))):
        back[i] = least[: i + 1].max()
    return np.flatnonzero((half == back) & (back > 0) & (w.room() >= window // 2))


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in pieces(batches):
            if len(w.hashes) < window:
                continue
            half = windows(w.hashes, window // 2)
            half |= U(1)  # 0 marks void places
            at = _anchor_places(w, half, window)
            owner = w.owner()[at]
            ids = batch.column("id").to_numpy(zero_copy_only=False)[owner]
            places = at - w.first[owner]
            # repeats of this piece are settled here: one row per hash travels to its partition, with a mark;
            # the others only need to be listed, so they go anywhere
            order = np.lexsort((places, ids, half[at]))
            h = half[at][order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            again = ~new
            again[:-1] |= ~new[1:]
            h = np.where(new, h, mix(h + order.astype(U)))
            yield _table(h=h.view(np.int64), id=ids[order], place=places[order].astype(np.int32), again=again)

    return run


def _repeated_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those that share it with a neighbour, or are marked."""

    def emit(held, before, after):
        h, ids, places, again = held
        same = np.zeros(len(h) + 1, bool)
        same[0] = before is not None and before == h[0]
        same[1:-1] = h[1:] == h[:-1]
        same[-1] = after is not None and after == h[-1]
        keep = same[:-1] | same[1:] | again
        return _table(id=ids[keep], place=places[keep])

    held = last = None  # whether the last row stays depends on the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "id", "place", "again"))
        if held is not None:
            yield emit(held, last, now[0][0])
            last = held[0][-1]
        held = now
    if held is not None:
        yield emit(held, last, None)


def _candidates(window: int):
    """Windows around repeated anchors: of those equal in a piece, the first travels, the others are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in pieces(batches):
            n = len(w.hashes)
            near = np.zeros(n + 1, np.int64)
            for at, step in zip(run_edges(batch.column("runs"), w), (1, -1)):
                np.add.at(near, at, step)
            start = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (w.room() >= window))
            if not len(start):
                continue
            whole = windows(w.hashes, window)[start]
            check = windows(mix(w.hashes + U(0x51)), window)[start]
            owner = w.owner()[start]
            ids = batch.column("id").to_numpy(zero_copy_only=False)[owner]
            places = (start - w.first[owner]).astype(np.int32)
            order = np.lexsort((places, ids, check, whole))
            whole, check, ids, places = whole[order], check[order], ids[order], places[order]
            new = np.ones(len(order), bool)
            new[1:] = (whole[1:] != whole[:-1]) | (check[1:] != check[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            later = (ids != ids[first]) | (places != places[first])
            key = np.where(later, mix(whole + order.astype(U)), whole)  # settled rows go anywhere
            yield _table(h=key.view(np.int64), h2=check.view(np.int64), id=ids, place=places, later=later)

    return run


def _later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by mark, hashes, id and place: the marked ones, and those later than the first of their hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, i, p, done = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "h2", "id", "place", "later"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (done[1:] != done[:-1])
        new[0] = last is None or (a[0], b[0], done[0]) != last[:3]
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        before = (0, 0) if last is None else last[3:]
        first_id = np.where(head >= 0, i[head], before[0])
        first_place = np.where(head >= 0, p[head], before[1])
        later = done | (i != first_id) | (p != first_place)
        yield _table(id=i[later], place=p[later])
        last = (a[-1], b[-1], done[-1], first_id[-1], first_place[-1])


def run_edges(runs: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of all texts, as places in the words of the piece."""
    lengths = runs.value_lengths().fill_null(0).to_numpy()
    flat = runs.flatten()
    head, last = (np.repeat(x, lengths) for x in (w.first[:-1], w.first[1:]))
    return tuple(np.minimum(flat.field(c).to_numpy(zero_copy_only=False) + head, last) for c in ("start", "stop"))


def _runs(back: int, ahead: int):
    """Sorted ``(id, place)`` rows as runs of the places from ``place - back`` up to ``place + ahead``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "place"))
            cut = np.ones(len(ids), bool)
            cut[1:] = (ids[1:] != ids[:-1]) | (place[1:] - back > place[:-1] + ahead)
            heads = np.flatnonzero(cut)
            tails = np.append(heads[1:], len(ids)) - 1
            yield _table(id=ids[heads], start=np.maximum(place[heads] - back, 0), stop=place[tails] + np.int32(ahead))

    return run


def _run_lists(places: DataFrame, back: int, ahead: int) -> DataFrame:
    """``(id, runs)`` of rows ``(id, place)``; a list is at most as long as its text."""
    ordered = places.repartition("id").sortWithinPartitions("id", "place")
    runs = ordered.mapInArrow(_runs(back, ahead), "id long, start int, stop int")
    return runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its stored size is under the limit; else the join shuffles."""
    return F.broadcast(df) if size_in_bytes(df) <= BROADCAST_LIMIT_BYTES else df


def whole_copies(texts: DataFrame) -> DataFrame:
    """``(id, d, keeper)`` of rows ``(id, d)`` whose digest ``d`` a smaller id, the ``keeper``, has as well."""
    firsts = texts.groupBy("d").agg(F.min("id").alias("keeper"), F.max("id").alias("most")).filter("keeper < most")
    firsts = small(materialise(firsts.drop("most")))
    return texts.join(firsts, "d").filter("id > keeper").select("id", "d", "keeper").distinct()


def removed_runs(docs: DataFrame, copies: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, runs)``: sorted runs of removed words of ``docs`` ``(id, text, d)``, but for ``copies`` ``(id, ds)``.

    Runs of one document may touch or overlap.
    """
    texts = docs.select("id", "text")
    anchors = texts.mapInArrow(_anchors(window), "h long, id long, place int, again boolean")
    places = anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated_places, "id long, place int")
    near = _run_lists(places, window - window // 2, 1)
    side = small(materialise(near.join(copies, "id", "left")))
    # a copy needs no windows of its own: the text it copies has them all
    windows_of = docs.join(side, "id").filter("NOT coalesce(array_contains(ds, d), false)")
    found = windows_of.select("id", "text", "runs").mapInArrow(
        _candidates(window), "h long, h2 long, id long, place int, later boolean"
    )
    later = (
        found.repartition("h")
        .sortWithinPartitions("later", "h", "h2", "id", "place")
        .mapInArrow(_later_places, "id long, place int")
    )
    return _run_lists(later, 0, window)


def _rest(window: int, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in pieces(batches):
            gone = np.zeros(len(w.hashes) + 1, np.int64)
            for at, step in zip(run_edges(batch.column("runs"), w), (1, -1)):
                np.add.at(gone, at, step)
            copies = batch.column("is_copy").to_numpy(zero_copy_only=False) & (w.counts >= window)
            stay = (np.cumsum(gone)[:-1] == 0) & ~np.repeat(copies, w.counts)
            sums = np.append(0, np.cumsum(~stay))
            raw, kept = w.data.tobytes(), []
            for i in range(batch.num_rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if joined:
                    at = np.flatnonzero(stay[a:b]) + a
                    kept.append(b" ".join([raw[x:y] for x, y in zip(w.starts[at].tolist(), w.ends[at].tolist())]))
                else:
                    kept.append(_cut(raw, w, i, stay[a:b]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row_id", "is_null", "carried")),
                    pa.array(w.counts, pa.int64()),
                    pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["row_id", "is_null", "carried", "n_words", "n_removed", "kept_text"],
            )

    return run


def _cut(raw: bytes, w: Words, i: int, stay: np.ndarray) -> bytes:
    """The text without removed words and the white space after them."""
    begin, end, a = int(w.offsets[i]), int(w.offsets[i + 1]), int(w.first[i])
    turns = np.flatnonzero(np.diff(np.concatenate(([True], stay, [True])).astype(np.int8)))
    if not len(turns):
        return raw[begin:end]
    edges = np.append(w.starts[a : a + len(stay)], end)[turns].tolist()
    return b"".join(raw[x:y] for x, y in zip([begin, *edges[1::2]], [*edges[0::2], end]))


def dedup_substrings(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    joined: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(<id_col>, n_words, n_removed, kept_text, carried)``, one row per row of ``docs``.

    ``joined``: kept words with one space between; else the text without the removed words, white space and all.
    A null text stays null (``joined``: is empty). ``carried`` is a struct of the columns named in ``carry`` (null
    if there are none); others are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        (F.struct(*carry) if carry else F.lit(None).cast("boolean")).alias("carried"),
    ).withColumn("d", F.unhex(F.sha2("text", 256)))
    copies = materialise(whole_copies(rows.filter("text IS NOT NULL").select("id", "d")))
    copies = materialise(copies.groupBy("id").agg(F.collect_set("d").alias("ds")))  # texts of one id
    side = small(settle(docs.sparkSession, lambda: removed_runs(rows, copies, window).join(copies, "id", "full")))
    copy = F.coalesce(F.array_contains("ds", F.col("d")), F.lit(False))
    marked = rows.join(side, "id", "left").select(
        "row_id", "text", "runs", "carried", copy.alias("is_copy"), F.col("text").isNull().alias("is_null")
    )
    kind = rows.select("carried").schema["carried"].dataType.simpleString()
    rest = marked.mapInArrow(
        _rest(window, joined),
        f"row_id long, is_null boolean, carried {kind}, n_words long, n_removed long, kept_text string",
    )
    text = F.col("kept_text") if joined else F.when(~F.col("is_null"), F.col("kept_text"))
    return rest.select(F.col("row_id").alias(id_col), "n_words", "n_removed", text.alias("kept_text"), "carried")
