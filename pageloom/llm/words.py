"""Words of whole texts as hash arrays: the numpy side shared by the word-based operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8 text. Hashes are 64
bits wide and depend on the word alone, never on its place, the batch or the machine. Work runs on one
Arrow batch at a time, in pieces of about :data:`PIECE_BYTES`, so memory follows the batch and the
longest single text, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_BLOCK = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd, and 3 modulo 4: powers of it stay apart modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of a public splitting generator)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    if n > 1:
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


@dataclass
class Words:
    """Words of consecutive texts: bytes, hash, place, and the first word of each text."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_texts + 1 offsets into the words
    offsets: np.ndarray  # n_texts + 1 offsets into the bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text start there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges are sorted and do not overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        n = int(ends[j - 1] - base)
        up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[data[base : base + n]] * up[:n], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U)
        i = j
    return mix(out)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    space = np.ones(n + 1, bool)
    space[:n] = _SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.ones(n + 1, bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | begins))
    # a word ends where the next byte is a space or another text begins
    ends = np.flatnonzero(~before & (space | begins))
    first = np.searchsorted(starts, offsets)
    return Words(data, hash_ranges(data, starts, ends), starts, ends, first, offsets)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; what Arrow has kept of them goes back when the partition ends, as workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Batches cut into runs of whole texts of about :data:`PIECE_BYTES`, with their words."""
    for batch in released(batches):
        if not batch.num_rows:
            continue
        data, offsets = texts_of(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
            own = offsets[i : j + 1]
            yield batch.slice(i, j - i), find_words(data[own[0] : own[-1]], own - own[0])
            i = j


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on, by doubling; the last ``size - 1`` places are void.

    Values at places whose window leaves its text are void as well: check :meth:`Words.room`.
    """
    parts, done, power, length = hashes, None, 1, 0
    while True:
        if size & power:
            done = parts if done is None else _pair(done, parts, length)
            length += power
        power *= 2
        if power > size:
            return done
        parts = _pair(parts, parts, power // 2)


def _pair(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Hash of ``left`` at each place with ``right`` ``gap`` places on (places past the end wrap, and are void)."""
    return mix(left * U(0xD6E8FEB86659FD93) + np.roll(right, -gap) + U(2 * gap + 1))


def sliding(values: np.ndarray, size: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) of each ``size`` consecutive values, by doubling; the end is void."""
    out, length = values, 1
    while length < size:
        step = min(length, size - length)
        out = take(out, np.roll(out, -step))
        length += step
    return out
