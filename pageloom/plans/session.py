"""Session settings the plans rely on, and where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Runtime-changeable settings: adaptive plans split skewed joins and size partitions by data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # pages differ widely in size: bound Arrow batches by bytes as well as by rows (each is held on both sides)
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}
# Planned sizes count compressed files; rows in memory may take several times as much.
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session the caller made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of its own; a cluster must name a shared one,
    since executors that take over lost work have to find the tables there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = configured or spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="pageloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/pageloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below this application's scratch folder."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables once no plan reads them any more."""
    _delete(spark, _own_folder(spark))


# paths given out inside the innermost open :func:`settle`; other threads (stream consumers, other queries) have their own
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` plans, stored; scratch tables made while building it are deleted then."""
    path = fresh_path(spark, "table")
    used: list[str] = []
    outer = _made.set(used)
    try:
        df = build()
        df.write.parquet(path)
    finally:
        _made.reset(outer)
        for scratch in used:
            _delete(spark, scratch)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table below the scratch root and read it back.

    Cuts lineage, survives lost executors and gives later joins exact size statistics.
    """
    return materialise_counted(df)[0]


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`materialise`, with the row count observed during the write."""
    path = fresh_path(df.sparkSession, "table")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Redistribute by ``key`` only if the scan has fewer partitions than the cluster has cores.

    Such an input is small (each partition is at most one scan split), so the shuffle is bounded;
    a large scan is left where it is. Where narrow rows grow into much work, a scan split is no measure of it: with
    ``rows``, there are as many partitions as leave about that many rows to each, so a task stays as long however
    large the table.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
