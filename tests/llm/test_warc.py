"""Archives round trip; the merged history is the sorted whole."""

import hashlib
import random

import pytest
from pageloom.llm.warc import capture_history, merged, parse, url_key

NASTY = "x" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é" * 20


def test_tree_of_losers():
    random.seed(2)
    for k in range(9):
        runs = [sorted(random.randrange(30) for _ in range(random.randrange(12))) for _ in range(k)]
        got = [(runs[r][p], r, p) for r, p in merged(runs)]
        assert got == sorted((x, r, p) for r, own in enumerate(runs) for p, x in enumerate(own))


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.Example.com/A?b=C", "com,example)/a?b=C"),
        ("https://a.b.example:8080", "example,b,a:8080)/"),
        ("not a url", "not a url"),
        ("http://[bad", "http://[bad"),
    ],
)
def test_url_key(url, key):
    assert url_key(url) == key


def test_odd_rows(spark):
    long = "same payload " * 20
    rows = [(1, "http://a.example/1", None), (2, None, ""), (3, "http://a.example/2", NASTY), (9, "http://b.example/", NASTY)]
    rows += [(5, "http://c.example/\nx", long), (4, "http://c.example/y", long), (4, "http://c.example/y", long)]
    rows += [(7, "u", "short"), (8, "u", "short"), (None, "u", long)]
    df = spark.createDataFrame([(*r, "a", 0) for r in rows], "page_id long, url string, html string, digest string, n int")
    got = capture_history(df.repartition(3)).collect()
    first = {NASTY: 3, long: 4}
    want = []
    for ident, _, html in rows:
        data = (html or "").encode()
        again = html in first and ident is not None and ident > first[html]
        want.append((ident, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    order = [(r.url_key, r.captured, r.page_id or 0) for r in sorted(got, key=lambda r: (r.history_range, r.history_place))]
    assert order == sorted(order)


def test_index_offsets(spark, tmp_path):
    from pageloom.llm.warc import write_archives

    df = spark.createDataFrame([(i, f"http://h/{i}", NASTY + str(i)) for i in range(20)], "page_id long, url string, html string")
    path = write_archives(df.coalesce(1), str(tmp_path / "w"))
    (name,) = (tmp_path / "w").glob("part-*")
    data = name.read_bytes()
    for row in parse(data, "n"):
        (again,) = parse(data[row[8] : row[8] + row[9]], "n")
        assert again[:7] == row[:7]


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    from pageloom.llm.warc import ARCHIVE_BYTES, read_runs, write_archives

    sizes = [10] * 40 + [300_000] * 70 + [2 << 20] * 11 + [ARCHIVE_BYTES + 5] * 2
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "page_id long, n int")
    df = df.selectExpr("page_id", "concat('http://h/', page_id) AS url", "concat(repeat('x', n), page_id) AS html")
    path = write_archives(df.coalesce(1), str(tmp_path / "w"))
    found = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    for data in found:
        assert len(data) <= ARCHIVE_BYTES + (1 << 16) or len(parse(data, "n")) == 1
    got = {r.page_id: r.payload_bytes for r in read_runs(spark, path).collect()}
    assert got == {i: n + len(str(i)) for i, n in enumerate(sizes)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert capture_history(df).count() == 0
