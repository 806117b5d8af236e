"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

A document is its token ids and a closing id. Documents longer than a sequence are cut into whole
sequences and a rest; others stay whole. Stored pieces fall into groups of about ``GROUP`` by row number, and each group is
packed by itself, longest pieces first: with ``N(g)`` open sequences of gap ``g``, a piece of length ``l``
goes where the sum of all ``N(g) ** 2`` becomes smallest, that is to the gap with the least
``N(g - l) - N(g)``; a new sequence opens only if no open one has room, as sequences shall be few. A
second round packs the sequences that stay open, of many groups together, by the same rule.

A group is bounded, so is its task; only lengths and keys are shuffled, never ids. Defined results: a null
text is empty, and an empty text is the closing id alone; repeated rows are packed like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.substrings import small
from pageloom.llm.tokens import run_ids
from pageloom.llm.words import released
from pageloom.plans.session import materialise, materialise_counted

LENGTH = 2048
CLOSING_ID = 0
GROUP = 4096
_BINS = 1 << 20


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length: the sequence it goes to and its offset there."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    n = 0
    never = np.int64(1) << 60
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        # moving a sequence from gap g to g - size changes the sum by 2 * (N(g - size) - N(g) + 1);
        # a full one leaves the sum, which saves one more
        change = np.where(count[size:] > 0, 2 * (count[: capacity + 1 - size] - count[size:] + 1), never)
        if change[0] < never:
            change[0] = 1 - 2 * count[size]
        gap = int(change.argmin()) + size
        if change[gap - size] == never:
            bin_, gap, n = n, capacity, n + 1
        else:
            bin_ = open_[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = bin_, capacity - gap
        if gap > size:
            open_[gap - size].append(bin_)
            count[gap - size] += 1
    return sequence, offset


def _pieces(path: str, capacity: int, closing: int, with_ids: bool):
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = run_ids(path).ids
        for batch in released(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    values = (ident, i, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<i4"))
                    for column, value in zip(rows, values if with_ids else values[:5]):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds[: len(names)])], names)

    return run


_PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    path: str,
    capacity: int = LENGTH,
    closing: int = CLOSING_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: the token pieces of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, capacity, closing, with_ids), _PIECE + (", ids array<int>" if with_ids else ""))


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        sequence, offset = place(group.column("length").to_numpy(), capacity)
        number = group.column("group").to_numpy() * _BINS + sequence
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset)
        )

    return run


def pack(pieces: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (with ``length``) and for each its ``sequence_id`` and ``offset``."""
    stored, n = materialise_counted(pieces)
    first = _grouped(stored, n, capacity, group)
    first = materialise(first)
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("length")).filter(F.col("length") < capacity)
    fill, n = materialise_counted(fill.withColumnRenamed("sequence_id", "old"))
    again = _grouped(fill, n, capacity, group)
    moved = again.select(
        F.col("old").alias("sequence_id"), (-F.col("sequence_id") - 1).alias("new"), F.col("offset").alias("shift")
    )
    out = first.join(small(materialise(moved)), "sequence_id", "left")
    return out.select(
        *pieces.columns,
        F.coalesce("new", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _grouped(rows: DataFrame, n: int, capacity: int, group: int) -> DataFrame:
    groups = max(1, -(-n // group))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    return (
        rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(_packed(capacity), schema)
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = LENGTH, closing: int = CLOSING_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of ``docs``."""
    return pack(token_pieces(docs, path, capacity, closing), capacity).withColumnRenamed("id", "doc_id")


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from pieces with ``ids``, ``sequence_id`` and ``offset``; each is one sequence long."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"))
