"""Connected components of an edge table, by hooking and contraction.

Each round hooks every node with a smaller neighbour to the least of them (a minimum, combined before the
shuffle), follows these pointers to their ends by squaring, and replaces nodes by their ends in the edges.
Hooked nodes are gone from the edges, so each is hooked once, and rounds end when no edge is left; a star is
done in one. Every step is an equi-join or a minimum stored in the shared scratch folder, so no component is
gathered in one task, and the driver sees row counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.llm.substrings import small
from pageloom.plans.session import materialise_counted


PART_ROWS = 200_000


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` stored, in as few partitions as its rows need, and its row count.

    A table of one partition is grouped and joined where it is, without a shuffle.
    """
    stored, n = materialise_counted(df)
    return stored.coalesce(max(1, -(-n // PART_ROWS))), n


def _ends(hooks: DataFrame) -> DataFrame:
    """Pointers ``(u, p)`` followed to their ends."""
    while True:
        further = small(hooks.select(F.col("u").alias("p"), F.col("p").alias("q")))
        moved, _ = compact(hooks.join(further, "p", "left"))
        if moved.filter("q IS NOT NULL").isEmpty():
            return hooks
        hooks = moved.select("u", F.coalesce("q", "p").alias("p"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, root)`` for every id that occurs in an edge; ``root`` is the least id of its component."""
    pairs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    live, n = compact(pairs.distinct())
    rounds: list[DataFrame] = []
    while n:
        hooks = _ends(compact(live.groupBy("u").agg(F.min("v").alias("p")))[0])
        rounds.append(hooks)
        side = small(hooks)
        moved = live.join(side, "u").select("p", "v")
        moved = moved.join(side.select(F.col("u").alias("v"), F.col("p").alias("w")), "v", "left")
        moved = moved.select(F.col("p").alias("x"), F.coalesce("w", "v").alias("y")).filter("x <> y")
        live, n = compact(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    if not rounds:
        return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)
    found = rounds.pop()
    while rounds:
        last = small(found.select(F.col("u").alias("p"), F.col("p").alias("q")))
        moved = rounds.pop().join(last, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        found, _ = compact(moved.unionByName(found))
    roots = found.select(F.col("p").alias("id"), F.col("p").alias("root")).distinct()
    return compact(found.select(F.col("u").alias("id"), F.col("p").alias("root")).unionByName(roots))[0]
