"""State of many jobs, keyed streams over several micro-batches, exports of nested bytes, generated URLs."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import job_states as JS
from pageloom.sinks import export as K
from pageloom.sources.pages import generated_urls
from pageloom.streaming import keyed, streams as J


def urls(spark, *pairs):
    return spark.createDataFrame(list(pairs), "job_name string, url string")


def size_of(path) -> int:
    found = (os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))
    return sum(map(os.path.getsize, found))


def test_many_jobs(spark, tmp_path):
    path = str(tmp_path / "s")
    JS.create(spark, path, spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "job_name string, job_type string"))
    with pytest.raises(ValueError, match="b already exists"):
        JS.create(spark, path, spark.createDataFrame([("b", "z")], "job_name string, job_type string"))
    with pytest.raises(ValueError, match='No such job "q"'):
        JS.save(spark, path, urls(spark, ("q", "1")))
    JS.save(spark, path, urls(spark, ("a", "1"), ("a", "2"), ("a", "2"), ("b", "1")))
    JS.save(spark, path, urls(spark, ("a", "3"), ("a", "1")))
    assert rows(JS.visited(spark, path)) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]
    JS.save(spark, path, urls(spark, ("a", "3"), ("a", "4")), replace=True)
    assert rows(JS.visited(spark, path)) == [("a", "3"), ("a", "4"), ("b", "1")]
    JS.save(spark, path, urls(spark, ("a", "1")))
    assert rows(JS.visited(spark, path, urls(spark, ("a", "")))) == [("a", "1"), ("a", "3"), ("a", "4")]
    assert rows(JS.states(spark, path)) == [("a", "x", 4), ("b", "y", 1), ("c", "x", 0)]
    JS.compact(spark, path, path + "2")
    assert rows(JS.visited(spark, path + "2")) == rows(JS.visited(spark, path))
    assert spark.read.parquet(path + "2/urls").count() == 4


def test_a_save_that_died_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    JS.create(spark, path, spark.createDataFrame([("a", "x")], "job_name string, job_type string"))
    half = urls(spark, ("a", "lost")).selectExpr("job_name", "url", "true AS visited", "1L AS version", "0 AS bucket")
    half.write.mode("append").partitionBy("bucket").parquet(f"{path}/urls")
    assert JS.visited(spark, path).isEmpty()


def test_a_save_writes_what_is_new(spark, tmp_path):
    path = str(tmp_path / "s")
    JS.create(spark, path, spark.range(50).selectExpr("concat('j', id) AS job_name", "'x' AS job_type"))
    many = spark.range(60_000).selectExpr("concat('j', id % 50) AS job_name", "concat('http://h.example/', xxhash64(id)) AS url")
    JS.save(spark, path, many)
    whole = size_of(f"{path}/urls")
    JS.save(spark, path, many.unionByName(urls(spark, ("j1", "new"), ("j2", "new"))))
    assert size_of(f"{path}/urls") - whole < whole / 20
    assert JS.visited(spark, path).count() == 60_002


@pytest.fixture
def several(spark, tmp_path):
    """``several(frames)``: a stream with one micro-batch per list of rows."""

    def make(schema: str, *batches: list):
        base = str(tmp_path / "source")
        for rows_ in batches:
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(base)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)

    return make


def drained(spark, stream, tmp_path, mode="append"):
    base = str(tmp_path / "drained")
    J.drain(stream, f"{base}/out", f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")


def test_first_flags_over_micro_batches(spark, several, tmp_path):
    stream = several("job string, seq long", [("a", 2), ("a", 1), ("b", 7)], [("a", 3), ("c", 9)], [("b", 8), ("c", 10), ("c", 11)])
    got = drained(spark, keyed.flag_first(stream, "job", "seq"), tmp_path)
    assert rows(got.select("job", "seq", "is_first")) == [
        ("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 7, True), ("b", 8, False), ("c", 10, False), ("c", 11, False), ("c", 9, True),
    ]
    assert got.select("batch").distinct().count() == 3


def test_first_flags_expire(spark, several, tmp_path):
    schema = "job string, seq long, at timestamp"
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    base = str(tmp_path / "source")
    for job, seq, d in (("a", 1, 1), ("b", 2, 10), ("b", 3, 11), ("a", 4, 12)):
        spark.range(1).select(F.lit(job).alias("job"), F.lit(seq).cast("long").alias("seq"), day(d).alias("at")).write.mode("append").parquet(base)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)
    got = drained(spark, keyed.flag_first(stream, "job", "seq", "at", idle_ms=48 * 3600 * 1000), tmp_path)
    assert rows(got.select("seq", "is_first")) == [(1, True), (2, True), (3, False), (4, True)]


ACTIONS = [
    [("f", 1, True, "p"), ("f", 2, True, "q"), ("g", 3, True, "r")],
    [("f", 4, False, "q"), ("g", 5, False, "r"), ("h", 6, False, "never")],
    [("f", 7, True, "q"), ("f", 8, False, "p"), ("g", 9, True, "s"), ("f", 10, True, "q")],
]


def test_retraction_restores_the_entry_before(spark, several, tmp_path):
    schema = "field string, seq long, is_add boolean, selector string"
    got = drained(spark, keyed.live_selectors(several(schema, *ACTIONS)), tmp_path, "update")
    steps = {(r["batch"], r["field"]): r["selector"] for r in got.collect()}
    assert steps == {
        (0, "f"): "q", (0, "g"): "r", (1, "f"): "p", (1, "g"): None, (1, "h"): None, (2, "f"): "q", (2, "g"): "s",
    }
    final = J.latest_updates(got, ["field"]).select("field", "seq", "selector")
    batch = spark.createDataFrame([a for rows_ in ACTIONS for a in rows_], schema)
    assert rows(final) == rows(keyed.live_selectors_of(batch).select("field", "seq", "selector"))


def test_nested_bytes_become_text(spark, tmp_path):
    latin, utf8 = "é".encode("latin-1"), "é".encode()
    row = ([utf8, latin, None], {b"k": {"a": [latin]}, utf8: None}, (latin, 1), None)
    schema = "l array<binary>, m map<binary,struct<a:array<binary>>>, s struct<x:binary,n:int>, t struct<y:binary>"
    df = spark.createDataFrame([row], schema)
    (got,) = K.decode_bytes(df).collect()
    assert got["l"] == ["é", "é", None] and got["s"] == ("é", 1) and got["t"] is None
    assert {k: v and v["a"] for k, v in got["m"].items()} == {"k": ["é"], "é": None}
    both = spark.createDataFrame([({latin: 1, utf8: 2},)], "m map<binary,int>")
    assert list(K.decode_bytes(both).first()["m"]) == ["é"]
    K.export_json(df, str(tmp_path / "out"))
    assert '"l":["é","é",null]' in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))


def test_generated_urls_leave_in_pieces(spark):
    def pages(seed):
        yield from (f"{seed}/{i}" for i in range(3_000_000 if seed == "many" else 2))

    seeds = spark.createDataFrame([("many", 1), ("few", 2)], "seed string, pos_of int")
    got = generated_urls(seeds, "seed", pages)
    counts = got.groupBy("seed").agg(F.count("*"), F.max("pos"), F.max(F.col("url") == F.concat("seed", F.lit("/"), "pos")))
    assert rows(counts) == [("few", 2, 1, True), ("many", 3_000_000, 2_999_999, True)]


def test_seeds_share_pieces(spark):
    from pyspark.sql import functions as F

    seeds = spark.range(0, 400, 1, 1).select("id", F.col("id").cast("string").alias("seed"))
    pages = lambda seed: (f"{seed}/{i}" for i in range(int(seed) % 4))
    got = generated_urls(seeds, "seed", pages, 100)
    assert rows(got, "id", "pos", "url") == sorted(((i, n, f"{i}/{n}") for i in range(400) for n in range(i % 4)), key=repr)

    # what leaves the worker as one batch arrives as one: 600 URLs in six batches
    batches = got.mapInArrow(lambda parts: (p.select(["pos"]).slice(0, 1) for p in parts), "pos long")
    assert batches.count() <= 7


def test_tables_of_many_jobs_are_not_sent_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many")
    jobs = spark.range(50).selectExpr("concat('j', id) AS job_name", "'scrapy' AS job_type", "concat('u', id % 7) AS url")
    JS.create(spark, path, jobs)
    JS.save(spark, path, jobs)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(JS.visited(spark, path))
    assert "Broadcast" in plan(JS.visited(spark, path, jobs))  # a few jobs are
    monkeypatch.setattr(JS, "SENT_JOBS", 49)
    some = JS.visited(spark, path, jobs)
    assert "Broadcast" not in plan(some) and some.count() == 50
    JS.save(spark, path, jobs.selectExpr("job_name", "'v' AS url").filter("job_name < 'j2'"), replace=True)
    got = JS.visited(spark, path).groupBy("url").count()
    assert rows(got.filter("url = 'v'"), "count") == [(12,)] and JS.states(spark, path).count() == 50
