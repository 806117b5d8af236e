"""Filtered clustering against plain integers: assignment, ties, centroids, odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pageloom.llm import clusters as C
from pageloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def integers(x, size):
    if x is None or len(x) != size or any(c is None or not math.isfinite(c) for c in x):
        return None
    return [math.floor(256 * float(c)) for c in x]


def brute(rows, k=40, rounds=5, size=64, seed=2):
    """Sorted ``(id, cluster, distance, cluster_inertia, inertia, sha)``, all in Python integers."""
    kept = [(i, v) for i, x in rows if (v := integers(x, size)) is not None]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, w)), c) for c, w in enumerate(centroids))
            yield i, v, c, d

    for _ in range(rounds):
        sums = {}
        for _, v, c, _ in assign():
            s = sums.setdefault(c, [0, [0] * size])
            s[0] += 1
            s[1] = [a + b for a, b in zip(s[1], v)]
        for c, (n, s) in sums.items():
            centroids[c] = [x // n for x in s]
    last = list(assign())
    inertia = {}
    for _, _, c, d in last:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, _, c, d in last), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = QUERIES["op13_pca_filtered_clusters"](spark, SMALL)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_bounds_spare_most_distances_and_lose_none():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (40, 64))
    v = centres[rng.integers(0, 40, 2000)] + rng.integers(-300, 300, (2000, 64))
    mean = v.mean(0)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    number, distance, computed = C.nearest(v, *C.rotate(v, mean, axes, 12), centres, *C.rotate(centres, mean, axes, 12))
    exact = ((v[:, None].astype(np.int64) - centres) ** 2).sum(2)
    assert (distance == exact.min(1)).all() and (number == exact.argmin(1)).all()
    assert computed < 2000 * 4


@pytest.mark.parametrize("leading", [1, 2, 3])
def test_ties_and_repeats_take_the_smaller_number(spark, leading):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 1 / 256, 2 / 256, -1 / 256]) for _ in range(3)]) for i in range(60)] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = C.cluster(table, k=7, rounds=3, size=3, leading=leading)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 7, 3, 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (None, [3.0, 3.0]),
        (8, [1.0, 2.0, 3.0]), (9, [-inf, 0.0]), (10, [-100_000.25, 100_000.0]), (1, [0.5, -0.5]),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string")
    found = C.cluster(table, k=3, rounds=2, size=2, leading=1)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 3, 2, 2)


def test_components_beyond_the_limit_are_left_out(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [2.0**19, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in C.cluster(table, k=2, size=2, leading=1).collect()] == [3]


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = C.cluster(table)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found.collect() == []
