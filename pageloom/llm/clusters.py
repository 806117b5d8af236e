"""Exact centroid clustering with PCA-rotated filtering.

Components ``x`` become integers ``floor(256 x)``, so distances, ties and centroids are exact. Distances to most
centroids are never computed:

1. One pass gathers first and second moments; their principal axes give a rotation ``R`` (any rotation keeps
   distances, this one puts most of them into few coordinates).
2. Each vector is stored with its ``leading`` rotated coordinates and the norm of what is left.
3. For a vector ``v`` and a centroid ``c``, projected distance plus squared difference of the residual norms bounds
   the squared distance from below. The centroid with the least bound is verified first; any other whose bound
   exceeds that distance is out. Survivors are verified in integers, ties go to the smaller number. Bounds are
   floating numbers, so a margin far above their rounding errors is taken off; it costs survivors, never a result.

A round is one narrow pass: tasks add up their vectors per centroid, and one number per centroid and component
is shuffled per task and reaches the driver, as do the centroids: both are of a fixed size. So a cluster that
holds a third of all vectors costs its task nothing extra. The last pass assigns and measures.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinite component are left out,
as are those with a component of :data:`LIMIT` or more in magnitude after scaling, whose squared distances would pass
64 bits; repeated rows count each; a null id hashes as an empty one. Centroids start as the kept vectors with the
least hash of ``<seed>:<id>``, ties by components; with fewer vectors than ``k`` there are as many as vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.plans.session import materialise

K, ROUNDS, SIZE, SEED = 40, 5, 64, 2
SCALE = 256
LEADING = 12
LIMIT = 1 << 27
PIECE = 1024


def integer_vectors(rows: DataFrame, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, v)`` of the kept vectors, as integers."""
    vectors = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")
    ).filter(F.size("x") == size)
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= LIMIT))
    return vectors.filter(~bad).select("id", F.transform("x", lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            v = _matrix(batch.column("v"), size).astype(np.float64)
            v = np.hstack([v, np.ones((len(v), 1))])
            total += v.T @ v
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    return run


def principal_axes(vectors: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the rotation whose columns are the principal axes, the widest first."""
    sums = vectors.select("v").mapInArrow(_moments(size), "i long, j long, s double")
    total = np.zeros((size + 1, size + 1))
    for row in sums.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (size + 1) ** 2 rows
        total[row["i"], row["j"]] = row["s"]
    n = max(total[size, size], 1.0)
    mean = total[size, :size] / n
    _, axes = np.linalg.eigh(total[:size, :size] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def rotate(v: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the others."""
    turned = (v - mean) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1))


def _rotated(mean: np.ndarray, axes: np.ndarray, leading: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotate(_matrix(batch.column("v"), size), mean, axes, leading)
            starts = np.arange(0, leading * len(rest) + 1, leading, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(starts, lead.reshape(-1)), pa.array(rest)],
                ["id", "v", "lead", "rest"],
            )

    return run


def nearest(
    v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance, both exact, and how many distances were computed."""
    norm, c_norm = (lead**2).sum(1) + rest**2, (c_lead**2).sum(1) + c_rest**2
    bound = (rest[:, None] - c_rest) ** 2
    for d in range(lead.shape[1]):
        bound += (lead[:, d, None] - c_lead[:, d]) ** 2
    bound -= 1e-9 * (norm[:, None] + c_norm) + 1e-6
    first = bound.argmin(1)
    best = ((v - centroids[first]) ** 2).sum(1)
    row, number = np.nonzero(bound <= best[:, None])
    exact = ((v[row] - centroids[number]) ** 2).sum(1)
    order = np.lexsort((number, exact, row))
    new = np.append(True, np.diff(row[order]) > 0)
    at = order[new]
    return number[at], exact[at], len(row)


class _Assign:
    """Assignment of Arrow batches to fixed centroids."""

    def __init__(self, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> None:
        self.centroids = centroids
        self.lead, self.rest = rotate(centroids, mean, axes, leading)

    def pieces(self, batches: Iterator[pa.RecordBatch]):
        size = self.centroids.shape[1]
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                v = _matrix(part.column("v"), size).astype(np.int64)
                lead, rest = _matrix(part.column("lead"), self.lead.shape[1]), part.column("rest").to_numpy()
                yield part, v, *nearest(v, lead, rest, self.centroids, self.lead, self.rest)[:2]

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per centroid and component, the sum of the task's vectors; component ``size`` counts them."""
        k, size = self.centroids.shape
        total = np.zeros((k, size + 1), np.int64)
        for _, v, number, _ in self.pieces(batches):
            np.add.at(total, number, np.hstack([v, np.ones((len(v), 1), np.int64)]))
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance in self.pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
            )


def cluster(
    rows: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    size: int = SIZE,
    seed: int = SEED,
    leading: int = LEADING,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, size, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = np.array([r["v"] for r in start], np.int64).reshape(len(start), size)
    mean, axes = principal_axes(vectors, size)
    stored = materialise(
        vectors.mapInArrow(
            _rotated(mean, axes, leading, size), "id long, v array<int>, lead array<double>, rest double"
        )
    )
    for _ in range(rounds if len(centroids) else 0):
        step = _Assign(centroids, mean, axes, leading)
        sums = stored.mapInArrow(step.sums, "i long, j long, s long").groupBy("i", "j")
        total = [[0] * (size + 1) for _ in centroids]
        for row in sums.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * (size + 1) rows
            total[row["i"]][row["j"]] = int(row["s"])
        # Python integers: sums are exact and // rounds down
        centroids = np.array(
            [[x // s[size] for x in s[:size]] if s[size] else own for s, own in zip(total, centroids.tolist())], np.int64
        )
    step = _Assign(centroids, mean, axes, leading)
    kind = "id long, cluster int, distance long"
    assigned = materialise(stored.mapInArrow(step.rows, kind)) if len(start) else spark.createDataFrame([], kind)
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    facts = [
        (i, inertia.get(i, 0), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist())
    ]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(  # k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
