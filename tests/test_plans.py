"""Slices, salted joins, scratch tables: exact whatever the split."""

import random
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import Window as W, functions as F

from pageloom.functions.binding import bind
from pageloom.plans import joins, session as PS, slices


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    data = [
        ("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.randint(-3, 3), f"v{rng.randint(0, 5)}" if rng.random() < 0.9 else None)
        for i in rng.sample(range(3000), 600)
    ]
    return spark.createDataFrame(data, "k string, seq long, delta long, v string").cache()


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_rank_equals_row_number(events, width):
    got = slices.rank(events, ["k"], ["seq"], slices.number_slice("seq", width), "rank")
    want = events.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy("seq")).cast("long"))
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_context_equals_windows(events, width):
    got = slices.with_context(
        events,
        ["k"],
        ["seq"],
        slices.number_slice("seq", width),
        before={"v": "last_v", "seq": "last_seq"},
        after={"v": "next_v"},
        lowest={"low": F.when(F.col("delta") == 3, F.col("seq"))},
    )
    over = W.partitionBy("k").orderBy("seq")
    want = events.select(
        "*",
        F.lag("v").over(over).alias("last_v"),
        F.lag("seq").over(over).alias("last_seq"),
        F.lead("v").over(over).alias("next_v"),
        F.min(F.when(F.col("delta") == 3, F.col("seq"))).over(W.partitionBy("k")).alias("low"),
    )
    assert got.columns == want.columns
    assert rows(got) == rows(want)


@pytest.mark.parametrize("width", [1, 13, 10_000])
def test_queue_survivors_equal_a_queue(events, width):
    queues: dict = {}
    for r in sorted(events.collect(), key=lambda r: r["seq"]):
        queue = queues.setdefault(r["k"], [])
        if r["delta"] >= 0:
            queue.append(r["seq"])
        elif queue:
            queue.pop(0)
    got = slices.queue_survivors(events, ["k"], ["seq"], slices.number_slice("seq", width), F.col("delta") >= 0)
    assert got.columns == events.columns
    assert rows(got, "k", "seq") == sorted([(k, s) for k in queues for s in queues[k]], key=repr)


def test_measured_slices_part_a_crowded_key(events, monkeypatch):
    """Rows of one key, close together, lie in several slices of like size; results equal the windows."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    cut = slices.measured(events, ["k"], ["seq"])
    sizes = {r["_cut"]: r["count"] for r in cut.groupBy("_cut").count().collect()}
    assert len(sizes) >= 10 and max(sizes.values()) < 120
    assert cut.filter("k = 'hot'").select("_cut").distinct().count() >= 6
    over = W.partitionBy("k").orderBy("seq")
    got = slices.rank(events, ["k"], ["seq"])
    assert got.columns == [*events.columns, "rank"]
    assert rows(got) == rows(events.withColumn("rank", F.row_number().over(over).cast("long")))
    got = slices.with_context(events, ["k"], ["seq"], before={"v": "last_v"}, after={"v": "next_v"}, lowest={"low": F.col("seq")})
    want = events.select(
        "*", F.lag("v").over(over).alias("last_v"), F.lead("v").over(over).alias("next_v"), F.min("seq").over(W.partitionBy("k")).alias("low")
    )
    assert rows(got) == rows(want)
    wide = slices.queue_survivors(events, ["k"], ["seq"], slices.number_slice("seq", 10_000), F.col("delta") >= 0)
    assert rows(slices.queue_survivors(events, ["k"], ["seq"], None, F.col("delta") >= 0)) == rows(wide)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, events, how):
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("z", 4)], "k string, w int")
    got = joins.salted_join(events, small, "k", how, hot_rows=100)
    assert rows(got, "k", "seq", "delta", "v", "w") == rows(events.join(small, "k", how), "k", "seq", "delta", "v", "w")


def test_lookup_join_broadcasts_only_what_is_small(spark, events, monkeypatch):
    small = spark.createDataFrame([("hot", 1), ("a", 3)], "k string, w int")
    want = rows(events.join(small, "k", "left"), "k", "seq", "w")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.lookup_join(events, small, "k"))
    monkeypatch.setattr(joins, "BROADCAST_LIMIT_BYTES", 0)
    salted = joins.lookup_join(events, small, "k")
    assert "_salt" in plan(salted)
    assert rows(salted, "k", "seq", "w") == want


def test_scratch_folder_comes_from_the_session(spark, events):
    assert PS.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    stored, count = PS.materialise_counted(events)
    assert count == 600
    assert rows(stored) == rows(events)
    assert f"{PS.scratch_root(spark)}/pageloom/{spark.sparkContext.applicationId}/" in stored.inputFiles()[0]
    PS.clear_scratch(spark)
    assert not Path(stored.inputFiles()[0].removeprefix("file:")).exists()


def test_spread_leaves_wide_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert PS.spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() == cores
    wide = spark.range(100).repartition(cores + 3)
    assert PS.spread(wide, "id") is wide


def test_spread_bounds_the_rows_of_a_task(spark):
    few = PS.spread(spark.range(1000).coalesce(1), "id", 10)
    assert few.rdd.getNumPartitions() == 100
    assert max(few.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 40
    assert few.count() == 1000 and few.distinct().count() == 1000


def test_bind_computes_its_value_once(spark):
    df = spark.range(20).select(bind(F.rand(), lambda x: F.array(x, x)).alias("a"))
    assert df.filter(F.col("a")[0] != F.col("a")[1]).isEmpty()


def test_selection_needs_no_shuffle(spark):
    from pageloom.operators import fields as Fd, select as S
    from pageloom.operators.shred import shred
    from pageloom.workload.items import TURN_SPEC

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").filter("page_id > 3")
    dom = shred(pages)
    plans = [S.values(dom, "nav ul > li:nth-child(2) a::href"), Fd.expand_items(Fd.collect_fields(Fd.extract_fields(dom, TURN_SPEC)))]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text
        assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in text


def test_page_lookup_reaches_the_scan(spark):
    from pageloom.sources.pages import page_by_url, read_pages

    df = page_by_url(read_pages(spark, "/root/testdata/sf0.001/pages.parquet"), "http://x/").select("page_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(url,http://x/)" in text
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_one_start_url_is_broadcast(spark):
    """A list made by the driver gets a size, so wide pages are not shuffled for one key."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    starts = spark.createDataFrame([("http://a.example/",)], "url string")
    plan = joins.keep_keys(pages, starts, "url")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_salting_takes_map_columns(spark):
    big = spark.createDataFrame([(i % 3, {"a": i}) for i in range(30)], "k long, m map<string,long>")
    little = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    got = joins.salted_join(big, little, "k", hot_rows=5)
    assert got.count() == 30 and got.filter("v IS NULL").count() == 10


def test_settle_leaves_only_its_result(spark):
    made = []

    def build():
        table = PS.materialise(spark.range(5))
        made.append(Path(table.inputFiles()[0].removeprefix("file://")))
        return table.filter("id > 2")

    kept = PS.settle(spark, build)
    assert rows(kept) == [(3,), (4,)]
    assert not made[0].exists()


def test_scans_do_not_grow_with_the_jobs(spark, tmp_path):
    from pageloom.model import CSS, FieldSelector, ItemSelector, Job, JobPath, KeyValueSelector, MainPage, Url, UrlSelector
    from pageloom.plans.crawl import run_jobs
    from pageloom.sources.records import site_params

    rows_ = [(i, f"http://h{i % 9}.example/{i}", f'<a href="/{(i * 7) % 90}">x</a><h1>{i}</h1>') for i in range(90)]
    spark.createDataFrame(rows_, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    spec = ItemSelector((KeyValueSelector("t", FieldSelector("h1::text", CSS)),))
    mains = [MainPage(UrlSelector("a", CSS), spec), MainPage(None, spec, UrlSelector("a", CSS))]
    params = site_params(spark, {"http://h1.example/": {"PREFERRED_SCRAPER": "selenium"}})

    def stages(n: int) -> tuple[int, int]:
        jobs = [Job(i, f"j{i}", JobPath().add(Url(f"http://h{i % 9}.example/{i}")).add(mains[i % 2])) for i in range(n)]
        df = run_jobs(jobs, pages, params)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert {r["job_name"] for r in df.select("job_name").collect()} == {f"j{i}" for i in range(n)}
        return plan.count("FileScan"), plan.count("MapInArrow")

    assert stages(2) == stages(30)
    assert stages(30)[1] == 1
