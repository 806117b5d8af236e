"""Proportional stratified interleaving into shards.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
``(rank + 1/2) / rows of its source``. All rows sorted by fractional rank interleave the sources in
proportion, and cutting that order into equal runs gives shards whose row counts differ by at most one and
whose mixture is that of the whole, up to one row a source at each cut.

Both orders are total sorts by range partitioning, so a source with a third of all rows is spread over many
tasks: a row's global position is its place in its stored partition plus the sizes of the partitions
before, and its rank is its position less that of the first row of its source. The driver sees one count per
partition. Only keys travel, not texts.

Defined results: a null source is a source of its own; equal rows keep separate slots; ties in the hash are
broken by id, checksum and size, and rows equal in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.llm.substrings import small
from pageloom.plans.session import materialise

SHARDS = 16
SEED = 20


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` and their ``position`` from 0 in the total order of the columns ``order``."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(
        ordered.withColumn("part", F.spark_partition_id()).withColumn(
            "place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        )
    )
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = small_table(rows, starts, "part int, before long")
    placed = numbered.join(F.broadcast(before), "part")  # one row per partition
    return placed.withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before")


def small_table(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def interleave(rows: DataFrame, source: str, *keys: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``keys`` name the columns that tell rows apart."""
    hashed = rows.withColumn("turn", F.xxhash64(F.lit(seed), *keys))
    ranked = materialise(with_position(hashed, source, "turn", *keys))
    sources = ranked.groupBy(source).agg(F.min("position").alias("first"), F.count("*").alias("n"))
    sources = small(materialise(sources.withColumnRenamed(source, "own")))
    ranked = ranked.join(sources, F.col(source).eqNullSafe(F.col("own"))).drop("own")
    rank = (F.col("position") - F.col("first") + 0.5) / F.col("n")
    sorted_ = with_position(
        ranked.withColumn("fraction", rank).drop("position", "first", "n"), "fraction", source, "turn", *keys
    )
    sorted_ = materialise(sorted_)
    total = sorted_.count()
    # the first total % shards shards have one row more
    size, more = divmod(total, shards)
    edge = more * (size + 1)
    at = F.col("position")
    shard = F.when(at < edge, F.expr(f"position div {size + 1}")).otherwise(
        more + F.expr(f"(position - {edge}) div {max(size, 1)}")
    )
    slot = F.when(at < edge, at % (size + 1)).otherwise((at - edge) % max(size, 1))
    out = sorted_.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))
    return out.drop("turn", "fraction", "position")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source: str = "source"
) -> DataFrame:
    """``(<id_col>, source, size, text_crc32, law, shard, slot)`` of every document; the law is ``rows``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = interleave(rows, "source", "id", "text_crc32", "size", shards=shards, seed=seed)
    return placed.withColumn("law", F.lit("rows")).withColumnRenamed("id", id_col)
