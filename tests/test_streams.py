"""Streams fed in several micro-batches end where their batch twins do."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.sources.events import read_events, with_event_time
from pageloom.streaming import streams as J

SCHEMA = "job long, seq long, ts timestamp_ntz, event_type string, item string"
FILES = [
    [(1, 1, "started", None), (1, 2, "item", "a"), (1, 3, "item", ""), (2, 4, "item", "x")],
    [(1, 5, "item", "b"), (2, 6, "closed", None), (3, 7, "started", None), (1, 8, "item", "a")],
    [(3, 9, "item", "z"), (3, 10, "closed", None), (2, 11, "item", "late")],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("events")
    for i, batch in enumerate(FILES):
        data = [(j, s, dt.datetime(2024, 1, 1, 0, s), e, v) for j, s, e, v in batch]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(out / f"f{i}"))
        for part in (out / f"f{i}").glob("*.parquet"):
            (out / f"{i}.parquet").write_bytes(part.read_bytes())
    return str(out)


@pytest.fixture
def stream(spark, folder):
    return read_events(spark, folder, SCHEMA, "?.parquet", files_per_trigger=1)


@pytest.fixture
def batch(spark, folder):
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "?.parquet").parquet(folder)


@pytest.fixture
def run(spark, tmp_path):
    def drain(stream, mode="append", keys=None):
        J.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode).awaitTermination()
        out = spark.read.schema(stream.schema.add("batch", "long")).parquet(str(tmp_path / "out"))
        return J.latest_updates(out, keys) if keys else out

    return drain


def is_item():
    return F.expr("event_type = 'item'")


def test_several_batches_arrive(stream, run):
    out = run(stream)
    assert out.select("batch").distinct().count() == 3
    assert out.count() == 11


def test_routing(stream, batch, run):
    items, _ = J.split_stream(stream, is_item(), F.col("item") == "")
    assert rows(run(items), "seq") == [(i,) for i in (11, 2, 4, 5, 8, 9)]
    _, others = J.split_stream(batch, is_item())
    assert rows(others, "seq") == [(1,), (10,), (6,), (7,)]


def test_running_counts(stream, batch, run):
    items, _ = J.split_stream(stream, is_item())
    twin, _ = J.split_stream(batch, is_item())
    got = run(J.running_counts(items, "job"), "update", ["job"])
    assert rows(got) == rows(J.running_counts(twin, "job")) == [(1, 4), (2, 2), (3, 1)]


def test_first_records(stream, batch, run):
    items, _ = J.split_stream(stream, is_item())
    got = run(J.first_records(items, "job", "seq", ["item"]), "update", ["job"])
    assert rows(got) == [(1, 2, "a"), (2, 4, "x"), (3, 9, "z")]
    twin, _ = J.split_stream(batch, is_item())
    assert rows(J.flag_first(twin, "job", "seq").filter("is_first"), "job", "seq", "item") == rows(got)


def test_completion(stream, batch, run):
    closed = F.col("event_type") == "closed"
    got = run(J.completion(stream, "job", closed), "update", ["job"])
    assert rows(got) == [(1, False), (2, True), (3, True)]
    assert rows(J.all_finished(got)) == [(3, 2, False)]
    assert rows(J.all_finished(J.completion(batch.filter("job > 1"), "job", closed))) == [(2, 2, True)]


def test_dedup(stream, run):
    links = stream.filter("event_type = 'item'").select("job", F.col("item").alias("key"))
    assert rows(run(J.dedup_links(links, ["job", "key"])), "job", "key") == [
        (1, ""), (1, "a"), (1, "b"), (2, "late"), (2, "x"), (3, "z"),
    ]


def test_dedup_with_bounded_state(stream, run):
    timed = with_event_time(stream).filter("event_type = 'item'").select("job", "ts", F.col("item").alias("key"))
    got = run(J.dedup_links(timed, ["job", "key"], "ts", "1 hour"))
    assert rows(got, "job", "key") == [(1, ""), (1, "a"), (1, "b"), (2, "late"), (2, "x"), (3, "z")]


def test_fold_keeps_the_last_action(stream, batch, run):
    is_add = F.col("event_type") != "closed"
    got = run(J.fold_actions(stream, "job", "seq", is_add, F.col("item")), "update", ["job"])
    assert rows(got) == rows(J.fold_actions(batch, "job", "seq", is_add, F.col("item")))
    assert rows(got) == [(1, True, "a"), (2, True, "late"), (3, False, None)]


def test_stopped_jobs(spark, stream, run):
    stopped = spark.createDataFrame([(1,), (1,)], "job long")
    assert rows(run(J.drop_stopped(stream, stopped, "job")).select("job").distinct()) == [(2,), (3,)]


def test_consumer_and_progress(spark, stream, tmp_path):
    seen = []
    query = J.for_each_item(stream, lambda df, i: seen.append((i, df.count())), str(tmp_path / "c1"), available_now=True)
    query.awaitTermination()
    assert seen == [(0, 4), (1, 4), (2, 3)]
    items = stream.select(F.concat(F.lit("j"), "job").alias("job_name"), F.col("event_type").alias("scraped_url"))
    J.record_progress(items, str(tmp_path / "p"), str(tmp_path / "c2"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.filter("job_name = 'j1'").select("url").distinct().count() == 2


def test_a_polling_query_keeps_running(stream, tmp_path):
    query = J.drain(stream, str(tmp_path / "out"), str(tmp_path / "c"), available_now=False)
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()


def test_one_query_feeds_both_consumers(stream, tmp_path):
    seen = {"items": [], "events": []}

    def keep(name):
        return lambda df, i: seen[name].append((i, sorted(r["seq"] for r in df.collect())))

    J.route(
        stream, is_item(), F.col("item") == "", keep("items"), keep("events"), str(tmp_path / "c"), available_now=True
    ).awaitTermination()
    assert seen["items"] == [(0, [2, 4]), (1, [5, 8]), (2, [9, 11])]
    assert seen["events"] == [(0, [1]), (1, [6, 7]), (2, [10])]


def test_a_key_in_one_piece_leaves_in_one_piece():
    import pandas as pd

    from pageloom.streaming import keyed

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

    part = lambda *seq: pd.DataFrame({"job": "a", "seq": seq})
    flagged = keyed._flagged(["job", "seq"], "seq", None, 0)
    state = State()
    (only,) = flagged(("a",), iter([part(3, 1, 2)]), state)
    assert only["is_first"].tolist() == [False, True, False] and state.value == ("1",)
    many = pd.concat(flagged(("a",), iter([part(3, 2), part(5, 1), part(4)]), State()))
    assert sorted(zip(many["seq"], many["is_first"])) == [(1, True), (2, False), (3, False), (4, False), (5, False)]
