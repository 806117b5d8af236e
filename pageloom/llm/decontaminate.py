"""Benchmark decontamination by canonical templates.

Words (runs without white space or punctuation, in lower case) become template tokens: a number, a name
(a capital inside a sentence) or a unit is a typed placeholder, anything else stands for itself; numbers side
by side are one placeholder. Windows of ``WINDOW`` tokens of benchmark items are looked up in every document,
under two keys: the template (if at least ``LITERALS`` tokens stand for themselves) and the plain words.
An item shorter than a window is one window; with fewer than ``LITERALS`` tokens it has none.

The windows of all items are a table by key, which the windows of the documents meet in a hash join. Before
they leave the task that reads a text, document windows pass a bit map of the items' keys (made by Spark's bitmap
aggregates; ``_FILTER_BITS`` bits for small benchmarks, 2^27 for the largest), so what is shuffled are windows that an
item has as well, and about one in sixty-four others. Items are broadcast only below the stored size that ``small``
checks; beyond it the join shuffles, and heavy keys are split.

Slots must agree: joined windows are brought together by document and item, and read in the order of the document in
*segments*, cut where no window of the item begins for as many tokens as the item has, or after four times as many
(which bounds what a task holds). In a segment verbatim windows count as they are; template windows count if every word
of the item stands for one word of the document, the alignment with the most windows deciding first. So a
re-parameterised question matches, a chance mixture does not, and a slot changed in one of its places only
loses the windows that hold it. An item is found in a document if, in one segment, the counting windows cover at
least ``COVERAGE`` of its tokens; the segment with the most is reported.

Defined results: null texts and items have no windows; rows sharing an id give rows of their own, equal rows
equal ones (on both sides); null ids stay null; of segments alike in coverage the one with fewer changed slots counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.substrings import small
from pageloom.llm.words import U, Words, find_words, mix, pieces, windows
from pageloom.plans.session import materialise_counted

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
_FILTER_BITS, _MOST_FILTER_BITS = 22, 27

# Units and number words that count as placeholders, in lower case.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years percent dollar dollars euro euros cent cents degree degrees celsius fahrenheit "
    "hz khz mhz ghz kb mb gb tb watt watts volt volts joule joules newton newtons usd eur"
).split()
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million "
    "zwei drei vier deux trois quatre cinq dos tres cuatro cinco"
).split()

_NUMBER, _NAME, _UNIT = U(11), U(13), U(17)


def _lookup() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    plain = np.arange(256, dtype=np.uint8)
    plain[65:91] += 32
    plain[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
    digit, stop = np.zeros(256, bool), np.zeros(256, bool)
    digit[48:58] = True
    stop[[ord(c) for c in ".!?:;\n"]] = True

    def hashes(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return np.sort(find_words(data, np.array([0, len(data)])).hashes)

    return plain, digit, stop, hashes(UNITS), hashes(NUMBERS)


_PLAIN, _DIGIT, _STOP, _UNIT_WORDS, _NUMBER_WORDS = _lookup()


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _flat(data: np.ndarray) -> np.ndarray:
    """Lower case without punctuation, byte for byte."""
    out = _PLAIN[data]
    if len(data) > 2:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 0x20
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        for i in range(3):
            out[marks + i] = 32
        signs = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], (0xA1, 0xAB, 0xBB, 0xBF)))
        for i in range(2):
            out[signs + i] = 32
    return out


def template(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of texts with template codes, and whether each stands for itself; numbers side by side are joined."""
    w = find_words(_flat(raw), offsets)
    n = len(w.hashes)
    if not n:
        return w, w.hashes, np.zeros(0, bool)
    first = np.zeros(n, bool)
    first[w.first[:-1][w.counts > 0]] = True
    number = _DIGIT[raw[w.starts]] | _member(w.hashes, _NUMBER_WORDS)
    stops = np.append(0, np.cumsum(_STOP[raw]))
    begins = first.copy()
    begins[1:] |= stops[w.starts[1:]] > stops[w.ends[:-1]]
    lead, after = raw[w.starts], raw[np.minimum(w.starts + 1, len(raw) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    # numbers side by side: one token with a joint hash
    joined = np.zeros(n, bool)
    joined[1:] = number[1:] & number[:-1] & ~first[1:]
    if joined.any():
        head = np.maximum.accumulate(np.where(joined, 0, np.arange(n)))
        hashes = w.hashes.copy()
        for i in np.flatnonzero(joined):
            hashes[head[i]] = mix(hashes[head[i] : head[i] + 1] * U(3) + w.hashes[i])[0]
        stay = ~joined
        counts = np.add.reduceat(np.append(stay, False).astype(np.int64), np.minimum(w.first[:-1], n)) * (w.counts > 0)
        w = Words(w.data, hashes[stay], w.starts[stay], w.ends[stay], np.append(0, np.cumsum(counts)), w.offsets)
        number, begins, capital = number[stay], begins[stay], capital[stay]
    unit = _member(w.hashes, _UNIT_WORDS)
    name = capital & ~begins & ~number & ~unit
    codes = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, w.hashes)))
    return w, codes, ~(number | unit | name)


def keys(w: Words, codes: np.ndarray, literal: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template keys, plain keys and validity of the windows of ``size`` tokens."""
    valid = w.room() >= size
    sums = np.append(0, np.cumsum(literal))
    at = np.arange(len(literal))
    enough = sums[np.minimum(at + size, len(literal))] - sums[at] >= LITERALS
    forms = np.where(enough, windows(codes, size), U(0))
    return forms | U(1), windows(w.hashes, size) & ~U(1), valid


_ITEM = "key long, item_id long, item_digest long, copies long, n_tokens int, size int, places array<int>, theirs array<long>"
_HIT = "key long, id long, digest long, rows int, size int, place int, own array<long>"


def _list(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def _tokens(w: Words, at: np.ndarray, size: int) -> pa.Array:
    """The words of the windows at some places."""
    flat = w.hashes[at[:, None] + np.arange(size)].reshape(-1).view(np.int64)
    return _list(flat, np.arange(len(at) + 1) * size)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items by key; those of the same words in one item are one row with all their places."""
    for batch, words in pieces(batches):
        w, codes, literal = template(words.data, words.offsets)
        owner = w.owner()
        for size in sorted({min(WINDOW, int(c)) for c in w.counts if c >= LITERALS}):
            forms, plain, valid = keys(w, codes, literal, size)
            at = np.flatnonzero(valid & (np.minimum(w.counts, WINDOW)[owner] == size))
            formed = at[forms[at] != 1]
            key, at = np.concatenate([forms[formed], plain[at]]), np.concatenate([formed, at])
            order = np.lexsort((at, plain[at], key, owner[at]))
            key, at = key[order], at[order]
            same = (owner[at[1:]] == owner[at[:-1]]) & (key[1:] == key[:-1]) & (plain[at[1:]] == plain[at[:-1]])
            heads = np.flatnonzero(np.append(True, ~same))
            first = at[heads]
            row = pa.array(owner[first])
            columns = [
                pa.array(key[heads].view(np.int64)),
                *(batch.column(c).take(row) for c in ("item_id", "item_digest", "copies")),
                pa.array(w.counts[owner[first]], pa.int32()),
                pa.array(np.full(len(heads), size, np.int32)),
                _list((at - w.first[owner[at]]).astype(np.int32), np.append(heads, len(at))),
                _tokens(w, first, size),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ITEM.split(", ")])


def _document_windows(sizes: list[int], bits: int, filled: np.ndarray):
    """Windows of documents whose key is in the bit map; equal rows of a piece are one, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in pieces(batches):
            w, codes, literal = template(words.data, words.offsets)
            if not len(w.hashes):
                continue
            ids = batch.column("id")
            rows = np.stack([ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy(), batch.column("digest").to_numpy()])
            _, first, count = np.unique(rows, axis=1, return_index=True, return_counts=True)
            number = np.zeros(batch.num_rows, np.int32)
            number[first] = count
            owner = w.owner()
            for size in sizes:
                forms, plain, valid = keys(w, codes, literal, size)
                valid &= number[owner] > 0
                for key in (forms, plain):
                    bit = (key >> U(64 - bits)).astype(np.int64)
                    at = np.flatnonzero(valid & (key != 1) & ((filled[bit >> 3] >> (bit & 7) & 1) > 0))
                    row = pa.array(owner[at])
                    columns = [
                        pa.array(key[at].view(np.int64)),
                        *(batch.column(c).take(row) for c in ("id", "digest")),
                        pa.array(number[owner[at]]),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array((at - w.first[owner[at]]).astype(np.int32)),
                        _tokens(w, at, size),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _HIT.split(", ")])

    return run


def _bit_map(windows_of_items: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a map with a bit per leading ``bits`` bits of a key: at most 16 MB, whatever the benchmark."""
    slot = F.expr(f"shiftrightunsigned(key, {64 - bits}) + 1")
    parts = windows_of_items.groupBy(F.bitmap_bucket_number(slot).alias("part"))
    filled = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map")).collect():
        part = np.frombuffer(row["map"], np.uint8)
        filled[(row["part"] - 1) * len(part) : row["part"] * len(part)] = part
    return filled


def best_cover(hits: list[tuple], n_tokens: int) -> tuple[float, int]:
    """Coverage and changed slots of one segment: ``hits`` are ``(place, document words, item places, item words)``."""
    covered = np.zeros(n_tokens, bool)
    bound: dict[int, int] = {}
    support = Counter(place - at for place, _, places, _ in hits for at in places)
    loose = []
    for place, own, places, theirs in hits:
        for at in places:
            if own == theirs:
                covered[at : at + len(own)] = True
                bound.update(zip(own, own))
            else:
                loose.append((-support[place - at], place - at, place, at, own, theirs))
    loose.sort(key=lambda x: x[:4])
    for *_, at, own, theirs in loose:
        if covered[at : at + len(own)].all():
            continue
        pairs = dict(zip(theirs, own))
        if all(pairs[x] == y and bound.get(x, y) == y for x, y in zip(theirs, own)):
            bound |= pairs
            covered[at : at + len(own)] = True
    return float(covered.mean()), sum(x != y for x, y in bound.items())


class _Match:
    """The joined windows of one document and one item, added in the order of the document."""

    def __init__(self, n_tokens: int, copies: int) -> None:
        self.n_tokens, self.copies = n_tokens, copies
        self.hits: list[tuple] = []
        self.seen: set = set()
        self.head = self.begin = self.last = None
        self.rows, self.best = 0, (0.0, 0)

    def add(self, place: int, key: int, rows: int, own: list, places: list, theirs: list) -> None:
        if self.begin is not None and (place > self.last + self.n_tokens or place > self.begin + 4 * self.n_tokens):
            self.close()
        mark = (place, key, places[0])
        if self.head is None:
            self.head = mark
        if mark == self.head:  # equal rows of other pieces bring the same windows again
            self.rows += rows
        if (place, places[0]) not in self.seen:  # a verbatim window comes under both keys
            self.seen.add((place, places[0]))
            self.hits.append((place, own, places, theirs))
        self.begin = place if self.begin is None else self.begin
        self.last = place

    def close(self) -> None:
        if self.hits:
            share, changed = best_cover(self.hits, self.n_tokens)
            self.best = max(self.best, (share, -changed))
        self.hits, self.seen, self.begin = [], set(), None


def _found(group: tuple, match: _Match) -> list[tuple]:
    match.close()
    share, changed = match.best
    return [(group[0], group[2], share, -changed)] * (match.rows * match.copies) if share >= COVERAGE else []


_FOUND = "id long, item_id long, coverage double, changed_slots int"


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items found, of rows sorted by document, item and place."""
    group, match, out = None, None, []
    for batch in batches:
        for *own, place, key, rows, words, places, theirs, n_tokens, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if tuple(own) != group:
                out += _found(group, match) if match else []
                group, match = tuple(own), _Match(n_tokens, copies)
            match.add(place, key, rows, words, places, theirs)
        yield from _emitted(out)
        out = []
    yield from _emitted(_found(group, match) if match else [])


def _emitted(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FOUND.split(", ")])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``(<id_col>, item_id, coverage, changed_slots)``: benchmark items found in documents."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("text")).filter("text IS NOT NULL")
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    items = items.withColumn("item_digest", F.xxhash64("text"))
    own, n = materialise_counted(items.mapInArrow(_item_windows, _ITEM))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # between LITERALS and WINDOW
    bits = min(_MOST_FILTER_BITS, max(_FILTER_BITS, (64 * n).bit_length()))
    hits = rows.mapInArrow(_document_windows(sizes, bits, _bit_map(own, bits)), _HIT)
    groups = ["id", "digest", "item_id", "item_digest"]
    joined = hits.join(small(own), ["key", "size"]).select(
        *groups, "place", "key", "rows", "own", "places", "theirs", "n_tokens", "copies"
    )
    ordered = joined.repartition(*groups).sortWithinPartitions(*groups, "place", "key", "places")
    return ordered.mapInArrow(_agree, _FOUND).withColumnRenamed("id", id_col)
