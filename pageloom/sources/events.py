"""Event sources for batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(
    spark: SparkSession,
    path: str,
    schema: str = EVENT_SCHEMA,
    pattern: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Events arriving as Parquet files below ``path``, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less timestamps as TIMESTAMP, which watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))
