"""Near duplicates by ProbMinHash: weighted sketches, bands, verification, components.

A text is a set of word shingles (five words; a shorter text is one shingle), each weighted by how often it occurs.
Each shingle is a Poisson process with its weight as rate whose arrivals fall on random places of the sketch; the
earliest arrival at a place wins it. A shingle stops as soon as its next arrival comes after every place's winner. Two
sketches agree at a place with the probability Jaccard similarity ``J`` of the weighted sets, the sum over common shingles
``i`` of ``1 / sum_j max(x_j / x_i, y_j / y_i)`` (the Jaccard similarity where all weights are 1). Bands of the sketch put
texts into buckets, so a pair of that similarity shares none with probability ``(1 - J ** rows) ** bands``, 3 in a million
at 0.8.

A pair is a *link* if its exact ``J`` is at least ``similarity``, with the weights or with all weights 1 (texts that repeat
a line unequally often may be alike as sets only). What sketches draw by is what defines a link: a text that repeats a
shingle is sketched in both ways, for any other they are the same.

1. *Waves.* In a bucket, texts are compared with a pivot, not with each other: the one that shares most buckets with
   others. A wave takes a few bands; links join components, and a text is compared no more with a pivot of its own
   component or one it has met. So thousands of copies cost about one comparison a text.
2. *The rest.* Buckets whose texts, but for the pivot, still lie in several components hold pairs never compared: texts
   with a common passage, alike but not enough. They fall into groups that share such buckets. Each group is cut into
   blocks of bounded size, and each pair of blocks is one small task: shared weights of all its pairs are two matrix
   products over the shingles that occur in several texts of the group. With ``s`` and ``t`` the shares of two texts'
   weights that are common, ``J`` is at most ``s t / (1 - (1 - s)(1 - t))``, and at most the sum over common shingles of
   the smaller share; only pairs that both leave are computed, and only links that join components come out. No pair
   is a row, and no pair of a bucket is left out.

Defined results: equal texts share a class; a null text, and one without words, is alone in its class;
rows sharing an id are one document. The class id is the least id in the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.components import compact, components
from pageloom.llm.substrings import small, whole_copies
from pageloom.llm.words import U, Words, mix, pieces, windows
from pageloom.plans.session import materialise, settle

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Bands of each wave; the last takes what is left.
WAVES = (2, 6)
#: Shingles, about, in a block of the last step.
BLOCK = 50_000
_NULL_ID = -(1 << 63)
_EXACT = 1e-9


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, hash and count, sorted by owner and hash."""
    owner, room, counts = w.owner(), w.room(), w.counts
    full = room >= size
    owners, values = [owner[full]], [windows(w.hashes, size)[full] if full.any() else w.hashes[:0]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            owners.append(short)
            values.append(windows(w.hashes, n)[w.first[short]])
    owners, values = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(new)
    return owners[at], values[at], np.diff(np.append(at, len(values)))


def sketch(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash sketches of ``n`` weighted sets: for each place, the value that arrived first (0: empty set)."""
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, U)
    time = np.zeros(len(value))
    turn = 0
    while len(value):
        turn += 1
        draw = mix(value + U(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = ((mix(draw ^ U(0xA5A5A5A5)) >> U(32)) * U(size) >> U(32)).astype(np.int64) + owner * size
        np.minimum.at(first, place, time)
        won = time == first[place]
        winner[place[won]] = value[won]
        going = time < first.reshape(n, size).max(1)[owner]
        owner, value, weight, time = owner[going], value[going], weight[going], time[going]
    return winner.reshape(n, size)


def _band_keys(places: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(places), bands), U) + np.arange(1, bands + 1, dtype=U)
    for r in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + places.reshape(-1, bands, rows)[:, :, r])
    return keys


def _sketches(size: int, bands: int, rows: int):
    """Ids and band keys of the texts with words: ``bands`` keys, or twice as many where a shingle is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in pieces(batches):
            owner, value, count = shingles(w, size)
            places = sketch(owner, value, count.astype(np.float64), batch.num_rows, bands * rows)
            keys = _band_keys(places, bands, rows)
            some = np.flatnonzero(w.counts > 0)
            again = np.unique(owner[count > 1])
            number = np.full(batch.num_rows, -1)
            number[again] = np.arange(len(again))
            own = np.isin(owner, again)
            plain = sketch(number[owner[own]], value[own], np.ones(int(own.sum())), len(again), bands * rows)
            plain = _band_keys(plain, bands, rows)
            both = np.concatenate([keys[some], plain]).reshape(-1).view(np.int64)
            ids = batch.column("id").take(pa.array(np.concatenate([some, again])))
            lists = pa.ListArray.from_arrays(np.arange(0, len(both) + 1, bands, dtype=np.int32), both)
            yield pa.RecordBatch.from_arrays([ids, lists], ["id", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in pieces(batches):
            owner, value, count = shingles(w, size)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            weight = count.astype(np.uint32)
            own = [(value[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            columns = [pa.array([x[i] for x in own], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "shingles", "weights"])

    return run


def probability_jaccard(x: np.ndarray, y: np.ndarray, x_all: float, y_all: float) -> float:
    """``J`` from the weights of the common shingles and the whole weights of both texts."""
    if not len(x):
        return 0.0
    order = np.argsort(x / y, kind="stable")
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    # where x_j / y_j is the larger quotient, x_j / x_i is the larger term (equal quotients give equal terms)
    over = np.cumsum(x[::-1])[::-1] / x
    under = (np.cumsum(y) - y) / y
    return float((1 / (over + under + (x_all - x.sum()) / x + (y_all - y.sum()) / y)).sum())


def _alike(x, y, x_size: int, y_size: int, x_all: float, y_all: float, similarity: float) -> bool:
    """Whether texts are near as sets or as weighted sets; ``x`` and ``y`` are the weights of the common shingles."""
    if len(x) >= similarity * (x_size + y_size - len(x)) - _EXACT:
        return True
    return probability_jaccard(x, y, x_all, y_all) >= similarity - _EXACT


def _similar(similarity: float):
    """Pairs whose weighted shingle sets have at least this probability Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sides = (batch.column(c) for c in ("shingles_a", "weights_a", "shingles_b", "weights_b"))
            for x, v, y, w in zip(*sides):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                v, w = np.frombuffer(v.as_buffer(), np.uint32), np.frombuffer(w.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = y[at] == x
                keep.append(_alike(v[same], w[at[same]], len(x), len(y), int(v.sum()), int(w.sum()), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The weighted shingle sets of both ends of ``pairs``."""
    for end in ("a", "b"):
        own = (F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("shingles", "weights")))
        pairs = pairs.join(sets.select(*own), end)
    return pairs


def _rooted(rows: DataFrame, roots: DataFrame | None, id_col: str = "id", name: str = "root") -> DataFrame:
    """``rows`` with the component of each id, itself where it has no link."""
    if roots is None:
        return rows.withColumn(name, F.col(id_col))
    known = small(roots.select(F.col("id").alias(id_col), F.col("root").alias(name)))
    return rows.join(known, id_col, "left").withColumn(name, F.coalesce(name, id_col))


def near_links(docs: DataFrame, similarity: float, size: int, bands: int, rows: int) -> DataFrame:
    """``(id, root)`` of the texts of ``docs`` ``(id, text)``, all different, that have a near duplicate."""
    keyed = docs.mapInArrow(_sketches(size, bands, rows), "id long, bands array<long>")
    keyed = materialise(keyed.select("id", F.posexplode("bands").alias("band", "key")).distinct())
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members, _ = compact(keyed.join(small(compact(shared)[0]), "key"))
    degree = small(compact(members.groupBy("id").agg(F.sum("n").alias("degree")))[0])
    best = members.join(degree, "id").groupBy("key").agg(F.expr("max_by(id, struct(degree, ~id))").alias("pivot"))
    best = small(compact(best)[0])
    sets = docs.join(degree.select("id"), "id", "left_semi").mapInArrow(_sets(size), "id long, shingles binary, weights binary")
    sets = materialise(sets)
    roots: DataFrame | None = None
    links: list[DataFrame] = []
    met: list[DataFrame] = []
    edges = [0, *(sum(WAVES[:i]) for i in range(1, len(WAVES) + 1)), bands]
    for low, high in zip(edges[:-1], edges[1:]):
        own = members.filter((F.col("band") >= low) & (F.col("band") < high)).join(best, "key").filter("id <> pivot")
        own = own.select("id", "pivot").distinct()
        own = _rooted(_rooted(own, roots), roots, "pivot", "pivot_root").filter("root <> pivot_root")
        pairs = own.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        for old in met:
            pairs = pairs.join(small(old), ["a", "b"], "left_anti")
        pairs, n = compact(pairs)
        if not n:
            continue
        met.append(pairs)
        found, n = compact(_both(pairs, sets).mapInArrow(_similar(similarity), "a long, b long"))
        if n:
            links.append(found)
            roots = components(reduce(DataFrame.unionByName, links))
    rest = _rooted(members.join(best, "key").filter("id <> pivot").select("key", "id"), roots)
    ends = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("id").alias("first"))
    open_, n = compact(ends.filter("x < y").select("key", "first"))
    if n:
        chains = rest.join(small(open_), "key").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
        group = components(compact(chains)[0]).select("id", F.col("root").alias("group"))
        found, n = compact(_block_links(_rooted(group, roots), sets, similarity))
        if n:
            links.append(found)
            roots = components(reduce(DataFrame.unionByName, links))
    if roots is None:
        return members.select("id", F.col("id").alias("root")).limit(0)
    return roots


def _block_links(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links between different roots of the texts ``(id, group, root)`` of a group."""
    texts, _ = compact(texts)
    own, _ = compact(sets.join(small(texts), "id").withColumn("size", F.octet_length("shingles") / 8))
    blocks = own.groupBy("group").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    blocks = small(compact(blocks)[0])
    dealt = own.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = dealt.select("group", "blocks", "block", "id", "root", "shingles", "weights").groupBy("group", "blocks", "block")
    schema = "group long, blocks int, block int, ids binary, roots binary, sizes binary, shingles binary, weights binary"
    packed, _ = compact(packed.applyInArrow(_pack, schema))
    # each pair of blocks meets once, and each block itself
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": low, "high": high}).drop("blocks", "other")
    return met.groupBy("group", "low", "high").applyInArrow(_compared(similarity), "a long, b long")


def _pack(group: pa.Table) -> pa.Table:
    """The texts of a block as one row."""
    sets = group.column("shingles").to_pylist()
    parts = {
        "ids": group.column("id").to_numpy().tobytes(),
        "roots": group.column("root").to_numpy().tobytes(),
        "sizes": np.array([len(x) // 8 for x in sets], np.int64).tobytes(),
        "shingles": b"".join(sets),
        "weights": b"".join(group.column("weights").to_pylist()),
    }
    keys = group.select(["group", "blocks", "block"]).slice(0, 1)
    for name, value in parts.items():
        keys = keys.append_column(name, pa.array([value], pa.binary()))
    return keys


class _Block:
    """Texts of a block: ids, roots, and one entry per shingle with its text, value and share of the text's weight."""

    def __init__(self, row: dict) -> None:
        self.ids, self.roots = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["roots"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.append(0, np.cumsum(sizes))
        self.value = np.frombuffer(row["shingles"], U)
        self.weight = np.frombuffer(row["weights"], np.uint32)
        self.total = np.bincount(self.owner, self.weight, len(sizes))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[i], self.first[i + 1])
        return self.value[own], self.weight[own]


def _holders(block: _Block, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a block on common shingles, shingle by shingle, and for each shingle where they begin and how many."""
    at = np.minimum(np.searchsorted(common, block.value), len(common) - 1)
    hit = np.flatnonzero(common[at] == block.value)
    order = np.argsort(at[hit], kind="stable")
    count = np.bincount(at[hit], minlength=len(common))
    return hit[order], np.cumsum(count) - count, count


def _shares(x: _Block, y: _Block) -> np.ndarray:
    """For each pair of texts: the shares of both weights that lie on common shingles, the number of those, and the sum
    of the smaller shares.

    A shingle of few texts adds to its pairs one by one, one of many is a column of a matrix product.
    """
    n, m = len(x.ids), len(y.ids)
    out = np.zeros((4, n, m))
    common = np.intersect1d(x.value, y.value)
    if x is y:  # a shingle of one text is common to no pair
        values, count = np.unique(x.value, return_counts=True)
        common = values[count > 1]
    if not len(common):
        return out
    x_entry, x_first, x_count = _holders(x, common)
    y_entry, y_first, y_count = _holders(y, common)
    x_share, y_share = x.weight / x.total[x.owner], y.weight / y.total[y.owner]
    pairs = x_count * y_count
    few = np.flatnonzero(pairs <= max(16, n * m // 1000))
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) // 2_000_000)) + 1) if len(few) else ():
        which = np.repeat(part, pairs[part])
        turn = np.arange(len(which)) - np.repeat(np.cumsum(pairs[part]) - pairs[part], pairs[part])
        i = x_entry[x_first[which] + turn // y_count[which]]
        j = y_entry[y_first[which] + turn % y_count[which]]
        cell = x.owner[i] * m + y.owner[j]
        for k, weights in enumerate((x_share[i], y_share[j], None, np.minimum(x_share[i], y_share[j]))):
            out[k] += np.bincount(cell, weights, n * m).reshape(n, m)
    many = np.flatnonzero(pairs > max(16, n * m // 1000))
    for a in range(0, len(many), 2048):
        part = many[a : a + 2048]
        sides = []
        for block, entry, first, count, share in (
            (x, x_entry, x_first, x_count, x_share),
            (y, y_entry, y_first, y_count, y_share),
        ):
            which = np.repeat(np.arange(len(part)), count[part])
            turn = np.arange(len(which)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            own = entry[first[part][which] + turn]
            has, shares = np.zeros((2, len(block.ids), len(part)), np.float32)
            has[block.owner[own], which], shares[block.owner[own], which] = 1, share[own]
            sides.append((has, shares))
        (x_has, x_shares), (y_has, y_shares) = sides
        out[:3] += x_shares @ y_has.T, x_has @ y_shares.T, x_has @ y_has.T
        for c in range(len(part)):
            i, j = np.flatnonzero(x_has[:, c]), np.flatnonzero(y_has[:, c])
            out[3][np.ix_(i, j)] += np.minimum.outer(x_shares[i, c], y_shares[j, c])
    return out


def _compared(similarity: float):
    """Links between the texts of two blocks, or within one, that join roots not yet joined there."""

    def run(group: pa.Table) -> pa.Table:
        rows = {r["block"]: r for r in group.to_pylist()}
        blocks = [_Block(rows[k]) for k in sorted(rows)]
        x, y = blocks[0], blocks[-1]
        s, t, both, least = _shares(x, y)
        able = (s * t >= (similarity - 1e-4) * (1 - (1 - s) * (1 - t))) & (least >= similarity - 1e-4)
        able |= both >= (similarity - 1e-4) * (np.diff(x.first)[:, None] + np.diff(y.first) - both)
        able &= x.roots[:, None] != y.roots
        if x is y:
            able = np.triu(able, 1)
        joined: dict[int, int] = {}

        def root(r: int) -> int:
            while r in joined:
                r = joined[r]
            return r

        out: list[tuple[int, int]] = []
        for i, j in zip(*np.nonzero(able)):
            p, q = root(int(x.roots[i])), root(int(y.roots[j]))
            if p == q:
                continue
            (u, v), (z, w) = x.of(i), y.of(j)
            _, a, b = np.intersect1d(u, z, assume_unique=True, return_indices=True)
            if _alike(v[a], w[b], len(u), len(z), x.total[i], y.total[j], similarity):
                joined[max(p, q)] = min(p, q)
                out.append((int(x.ids[i]), int(y.ids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, class_id)``, one row per row of ``docs``; other columns are not read."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    texts = texts.withColumn("d", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.sha2("text", 256))))
    digests = texts.select("id", "d").filter("d IS NOT NULL")
    copies = small(materialise(whole_copies(digests)))
    single = texts.filter("d IS NOT NULL").join(copies, ["id", "d"], "left_anti").select("id", "text")
    roots = small(settle(docs.sparkSession, lambda: near_links(single, similarity, size, bands, rows)))
    placed = (
        texts.select("row_id", "id", "d")
        .join(copies, ["id", "d"], "left")
        .withColumn("id", F.coalesce("keeper", "id"))
        .join(roots, "id", "left")
    )
    root = F.coalesce("root", "id")
    return placed.select(F.col("row_id").alias(id_col), F.when(root > _NULL_ID, root).alias("class_id"))
