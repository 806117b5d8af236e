"""Streaming queries over the event table, drained to their final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.plans.session import fresh_path
from pageloom.sources.events import read_events
from pageloom.streaming import keyed, streams as J
from pageloom.workload.registry import query, table


def _stream(spark, sf):
    return read_events(spark, sf, pattern="events.parquet")


def _drained(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its source and read what it wrote."""
    base = fresh_path(spark, "stream")
    J.drain(stream, f"{base}/out", f"{base}/checkpoint", mode).awaitTermination()
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{base}/out")


def _final(spark, stream: DataFrame, keys: list[str]) -> DataFrame:
    return J.latest_updates(_drained(spark, stream, "update"), keys)


BATCHES = 4
YEAR_MS = 365 * 24 * 3600 * 1000


def _in_batches(spark, sf):
    """The events as a stream of several micro-batches, in the order of their ids."""
    base = fresh_path(spark, "events")
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    for k in range(BATCHES):  # one after the other, as files are read in the order of their times
        own = F.floor(F.col("event_id") * BATCHES / (last + 1)) == k
        events.filter(own).repartition(1).write.mode("append").parquet(base)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(base)


IS_ITEM = "event_type IN ('view', 'click')"


@query(
    "routed_events",
    f"SELECT 'data' AS branch, event_id FROM events WHERE {IS_ITEM} AND value >= 1 UNION ALL SELECT 'event', event_id FROM events WHERE NOT ({IS_ITEM})",
)
def routed_events(spark, sf):
    base = fresh_path(spark, "routed")
    stream = _stream(spark, sf).select("event_id", "event_type", "value")
    writers = [J.batch_writer(f"{base}/{branch}") for branch in ("data", "event")]
    J.route(stream, F.expr(IS_ITEM), F.col("value") < 1, *writers, f"{base}/checkpoint", available_now=True).awaitTermination()
    read = [
        spark.read.schema("event_id long").parquet(f"{base}/{branch}").select(F.lit(branch).alias("branch"), "event_id")
        for branch in ("data", "event")
    ]
    return read[0].unionByName(read[1])


@query("drained_items", "SELECT event_id, user_id, props FROM events")
def drained_items(spark, sf):
    return _drained(spark, _stream(spark, sf).select("event_id", "user_id", "props")).drop("batch")


@query("running_item_counts", "SELECT user_id, count(*) AS items FROM events GROUP BY user_id")
def running_item_counts(spark, sf):
    return _final(spark, J.running_counts(_stream(spark, sf), "user_id"), ["user_id"])


@query(
    "first_record_per_job",
    "SELECT user_id, min(event_id) AS event_id, arg_min(props, event_id) AS props FROM events GROUP BY user_id",
)
def first_record_per_job(spark, sf):
    return _final(spark, J.first_records(_stream(spark, sf), "user_id", "event_id", ["props"]), ["user_id"])


@query(
    "records_flagged_first",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_first FROM events",
)
def records_flagged_first(spark, sf):
    return J.flag_first(table(spark, sf, "events"), "user_id", "event_id").select("event_id", "is_first")


@query("completed_jobs", "SELECT user_id, bool_or(event_type = 'purchase') AS closed FROM events GROUP BY user_id")
def completed_jobs(spark, sf):
    return _final(spark, J.completion(_stream(spark, sf), "user_id", F.col("event_type") == "purchase"), ["user_id"])


@query(
    "all_jobs_finished",
    "SELECT count(*) AS jobs, count(*) FILTER (closed) AS closed_jobs, count(*) = count(*) FILTER (closed) AS all_finished FROM "
    "(SELECT user_id, bool_or(event_type = 'purchase') AS closed FROM events GROUP BY user_id)",
)
def all_jobs_finished(spark, sf):
    done = J.completion(table(spark, sf, "events"), "user_id", F.col("event_type") == "purchase")
    return J.all_finished(done)


@query("streamed_link_keys", "SELECT DISTINCT event_type AS job, props AS key FROM events")
def streamed_link_keys(spark, sf):
    links = _stream(spark, sf).select(F.col("event_type").alias("job"), F.col("props").alias("key"))
    return _drained(spark, J.dedup_links(links, ["job", "key"])).drop("batch")


@query(
    "folded_actions",
    "SELECT user_id, arg_max(event_type <> 'error', event_id) AS is_add, arg_max(props, event_id) AS selector FROM events GROUP BY user_id",
)
def folded_actions(spark, sf):
    actions = _stream(spark, sf)
    folded = J.fold_actions(actions, "user_id", "event_id", F.col("event_type") != "error", F.col("props"))
    return _final(spark, folded, ["user_id"])


@query(
    "records_of_running_jobs",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) = 'error')",
)
def records_of_running_jobs(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    kept = J.drop_stopped(_stream(spark, sf), last.filter("last = 'error'"), "user_id")
    return _drained(spark, kept.select("event_id", "user_id")).drop("batch")


@query("streamed_progress", "SELECT DISTINCT 'job' || user_id AS job_name, 'http://e.example.com/' || event_type AS url FROM events")
def streamed_progress(spark, sf):
    base = fresh_path(spark, "progress")
    items = _stream(spark, sf).select(
        F.concat(F.lit("job"), "user_id").alias("job_name"),
        F.concat(F.lit("http://e.example.com/"), "event_type").alias("scraped_url"),
    )
    J.record_progress(items, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema("job_name string, url string, batch long").parquet(f"{base}/out").select("job_name", "url").distinct()


@query(
    "streamed_first_flags",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS is_first FROM events",
)
def streamed_first_flags(spark, sf):
    """Every record of several micro-batches, flagged in the stream."""
    stream = _in_batches(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    flagged = keyed.flag_first(stream, "user_id", "event_id", "at", YEAR_MS)
    return _drained(spark, flagged).select("event_id", "user_id", "is_first")


@query(
    "streamed_live_selectors",
    "WITH a AS (SELECT user_id AS field, event_type AS selector, arg_max(value >= 30, event_id) AS there, max(event_id) AS done FROM events GROUP BY 1, 2) "
    "SELECT field, max(done) AS seq, arg_max(selector, done) FILTER (there) AS selector FROM a GROUP BY field",
)
def streamed_live_selectors(spark, sf):
    """Selectors added and retracted over several micro-batches; a retraction restores the entry before."""
    actions = _in_batches(spark, sf).select(
        F.col("user_id").alias("field"),
        F.col("event_id").alias("seq"),
        (F.col("value") >= 30).alias("is_add"),
        F.col("event_type").alias("selector"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    return _final(spark, keyed.live_selectors(actions, event_time="at", idle_ms=YEAR_MS), ["field"])


@query("streamed_link_keys_bounded", "SELECT DISTINCT event_type AS job, props AS key FROM events")
def streamed_link_keys_bounded(spark, sf):
    """Link keys over several micro-batches, with state that forgets keys a year after they came."""
    links = _in_batches(spark, sf).select(
        F.col("event_type").alias("job"), F.col("props").alias("key"), F.col("ts").cast("timestamp").alias("at")
    )
    return _drained(spark, J.dedup_links(links, ["job", "key"], "at", "365 days")).select("job", "key")
