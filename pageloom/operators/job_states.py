"""State of many jobs at once: an append-only log in buckets of jobs, merged when read.

``states`` has a row per job and save; ``urls`` has a row per change of a visited URL, in folders by bucket of job and
save. A save writes what changed and nothing else; reading takes the latest row of each job and URL, so a
save that dies half-way, or runs again, changes nothing: URLs count from the state row of their save on.
:func:`compact` rewrites the buckets to what they amount to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.plans.session import materialise, materialise_counted

BUCKETS = 64
# Jobs up to which a table of them is broadcast; beyond, joins are dealt out, whatever size a compressed file suggests.
SENT_JOBS = 10_000
STATES = "job_name string, job_type string, version long"
URLS = "job_name string, url string, visited boolean, version long, bucket int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _bucket(job: str) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int")


def _sent(jobs: int | None) -> str:
    """How a table with a row for each of so many jobs is joined; unknown numbers count as many."""
    return "merge" if jobs is None or jobs > SENT_JOBS else "broadcast"


def states(spark: SparkSession, path: str) -> DataFrame:
    """``(job_name, job_type, version)``: the newest state of every job."""
    newest = _read(spark, f"{path}/states", STATES).groupBy("job_name").agg(F.max_by(F.struct("job_type", "version"), "version").alias("s"))
    return newest.select("job_name", "s.*")


def create(spark: SparkSession, path: str, jobs: DataFrame) -> None:
    """Add jobs ``(job_name, job_type)``; none may exist yet."""
    known = jobs.join(states(spark, path).hint("merge"), "job_name", "left_semi").select("job_name").first()
    if known is not None:
        raise ValueError(f"{known['job_name']} already exists")
    jobs.groupBy("job_name").agg(F.min("job_type").alias("job_type"), F.lit(0).cast("long").alias("version")).write.mode(
        "append"
    ).parquet(f"{path}/states")


def _latest(spark: SparkSession, path: str, jobs: DataFrame | None, count: int | None) -> DataFrame:
    """``(job_name, url, visited)``: the last change of each URL of ``jobs`` or all, of saves that were completed."""
    log = _read(spark, f"{path}/urls", URLS)
    done = states(spark, path).select("job_name", F.col("version").alias("upto"))
    if jobs is not None:
        done = done.join(jobs.select("job_name").distinct().hint(_sent(count)), "job_name", "left_semi")
    counted = log.join(done.hint(_sent(count)), "job_name").filter("version <= upto")
    return counted.groupBy("job_name", "url").agg(F.max_by("visited", "version").alias("visited"))


def save(spark: SparkSession, path: str, visited: DataFrame, replace: bool = False) -> None:
    """Record visited URLs ``(job_name, url)`` of existing jobs, as one more version of each.

    With ``replace`` the URLs given become the whole set of their jobs. Written are the URLs that change, first, and
    then one state row a job, which makes them count.
    """
    given = materialise(visited.select("job_name", "url").distinct())
    jobs, count = materialise_counted(given.select("job_name").distinct())
    now = states(spark, path)
    unknown = jobs.join(now.hint("merge"), "job_name", "left_anti").first()
    if unknown is not None:
        raise ValueError(f'No such job "{unknown["job_name"]}"')
    next_ = materialise(now.join(jobs.hint(_sent(count)), "job_name", "left_semi").withColumn("version", F.col("version") + 1))
    held = _latest(spark, path, jobs, count).filter("visited")
    changes = given.join(held.hint("merge"), ["job_name", "url"], "left_anti").withColumn("visited", F.lit(True))
    if replace:
        gone = held.join(given.hint("merge"), ["job_name", "url"], "left_anti").select("job_name", "url", F.lit(False).alias("visited"))
        changes = changes.unionByName(gone)
    rows = changes.join(next_.select("job_name", "version").hint(_sent(count)), "job_name").withColumn("bucket", _bucket("job_name"))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/urls")
    next_.write.mode("append").parquet(f"{path}/states")


def visited(spark: SparkSession, path: str, jobs: DataFrame | None = None) -> DataFrame:
    """``(job_name, url)`` visited by the named jobs, or by all."""
    count = None
    if jobs is not None:
        jobs, count = materialise_counted(jobs.select("job_name").distinct())
    return _latest(spark, path, jobs, count).filter("visited").select("job_name", "url")


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Write what the log amounts to below a new path."""
    newest = states(spark, path)
    kept = visited(spark, path).join(newest.select("job_name", "version").hint("merge"), "job_name")
    kept = kept.select("job_name", "url", F.lit(True).alias("visited"), "version", _bucket("job_name").alias("bucket"))
    kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{out}/urls")
    newest.write.parquet(f"{out}/states")
