"""Item and event streams.

State is kept by streaming aggregates and de-duplication, which fold rows map-side and spread keys
by hash; no per-key Python function ever sees a whole job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.plans.session import BROADCAST_LIMIT_BYTES, materialise, size_in_bytes

POLL_INTERVAL = "3 seconds"


def split_stream(stream: DataFrame, is_item: Column, is_empty: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Items to the data branch, everything else to the event branch; empty items vanish."""
    items = stream.filter(F.coalesce(is_item, F.lit(False)))
    if is_empty is not None:
        items = items.filter(~F.coalesce(is_empty, F.lit(True)))
    return items, stream.filter(~F.coalesce(is_item, F.lit(False)))


def running_counts(stream: DataFrame, job: str) -> DataFrame:
    """Items per job so far; use output mode ``update`` or ``complete``."""
    return stream.groupBy(job).agg(F.count("*").alias("items"))


def first_records(stream: DataFrame, job: str, order: str, columns: list[str]) -> DataFrame:
    """The first record of every job, as a streaming aggregate with one row of state per job."""
    first = stream.groupBy(job).agg(F.min_by(F.struct(order, *columns), order).alias("_first"))
    return first.select(job, "_first.*")


def flag_first(items: DataFrame, job: str, order: str) -> DataFrame:
    """Batch twin: every record with ``is_first``; joined on ``(job, order)``, so jobs stay spread."""
    first = items.groupBy(job).agg(F.min(order).alias(order)).withColumn("is_first", F.lit(True))
    return items.join(first, [job, order], "left").na.fill(False, ["is_first"])


def completion(stream: DataFrame, job: str, is_closed: Column) -> DataFrame:
    """Whether each job has closed."""
    return stream.groupBy(job).agg(F.max(is_closed).alias("closed"))


def all_finished(completed: DataFrame) -> DataFrame:
    """One row: jobs, closed jobs, and whether they are equal."""
    counted = completed.agg(F.count("*").alias("jobs"), F.count_if("closed").alias("closed_jobs"))
    return counted.withColumn("all_finished", F.col("jobs") == F.col("closed_jobs"))


def dedup_links(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Only link keys not seen before; with ``event_time`` the state forgets keys after ``delay``."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay or "1 day").dropDuplicatesWithinWatermark(keys)


def fold_actions(stream: DataFrame, field: str, order: str, is_add: Column, selector: Column) -> DataFrame:
    """The last action per field, kept current as actions arrive: ``field, is_add, selector``."""
    state = F.struct(is_add.alias("is_add"), selector.alias("selector"))
    folded = stream.groupBy(field).agg(F.max_by(state, F.col(order)).alias("_state"))
    return folded.select(field, "_state.is_add", "_state.selector")


def drop_stopped(stream: DataFrame, stopped: DataFrame, job: str) -> DataFrame:
    """Records of stopped jobs removed; the list is stored once, and broadcast only while it is small."""
    ids = materialise(stopped.select(job).distinct())
    side = F.broadcast(ids) if size_in_bytes(ids) <= BROADCAST_LIMIT_BYTES else ids
    return stream.join(side, job, "left_anti")


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL_INTERVAL)


def for_each_item(
    stream: DataFrame, consumer: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Hand every micro-batch to a consumer, every few seconds or until the source is drained."""
    writer = stream.writeStream.foreachBatch(consumer).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def route(
    stream: DataFrame,
    is_item: Column,
    is_empty: Column | None,
    on_items: Callable[[DataFrame, int], None],
    on_events: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """One query feeding two consumers: each micro-batch is read once and split in two.

    The micro-batch is cached while both consumers run; cached blocks that get lost are read from
    the source again.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        cached = batch.persist()
        try:
            items, events = split_stream(cached, is_item, is_empty)
            on_items(items, batch_id)
            on_events(events, batch_id)
        finally:
            cached.unpersist()

    return for_each_item(stream, split, checkpoint, available_now)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A consumer writing ``batch=<id>`` below ``path``; a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch as ``batch=<id>`` below ``path``; a replayed batch overwrites itself."""

    writer = stream.writeStream.outputMode(mode).foreachBatch(batch_writer(path))
    return _trigger(writer.option("checkpointLocation", checkpoint), available_now).start()


def latest_updates(drained: DataFrame, keys: list[str]) -> DataFrame:
    """Current state from drained ``update`` batches: the newest row of every key."""
    rest = [c for c in drained.columns if c not in keys and c != "batch"]
    newest = drained.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def record_progress(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append visited pages per micro-batch; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("job_name", F.col("scraped_url").alias("url")).distinct()
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_item(stream, write, checkpoint, available_now)
