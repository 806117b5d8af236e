"""WARC archives of captured pages, and an external merge of their capture indexes.

*Writing.* Every page becomes a ``WARC/1.1`` record with an HTTP block; its payload is the HTML in UTF-8. Of
pages with equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest id is a response, the
others are revisits that refer to it and carry no payload (its length stays in their HTTP header). Archives
are plain files written by Spark's text writer, and end every record as the format asks. They are bounded by
bytes: records of like size share archives, the fewer the larger they are (``SIZES``), so an archive holds about
``ARCHIVE_BYTES`` of URLs and payloads at most, or one record.

*Reading.* Each archive is parsed by record lengths (a payload may hold anything) into its capture index,
sorted by URL key, capture time and page: a run, stored on its own.

*Merging.* The runs are cut at common key ranges; each range merges its part of every run with a tree of
losers. A range is bounded in rows, and the full key decides the cuts, so a site with a third of all captures
spreads over many ranges. Ranges in order hold the captures in global order.

Defined results: null HTML is an empty payload; a null URL has the empty key; a null id never makes a page a
revisit; rows repeating the smallest id are all responses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.substrings import small
from pageloom.plans.session import fresh_path, materialise, materialise_counted

LEAST_BYTES = 100
RECORDS = 1000
ARCHIVE_BYTES = 16 << 20
# records below so many bytes, and how many of them make an archive
SIZES = [(ARCHIVE_BYTES // n, n) for n in (RECORDS, 64, 4)] + [(None, 1)]
RANGE_ROWS = 20_000
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"
INDEX = (
    "url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, archive string, record_offset long, record_bytes long"
)


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(record, size)``: one WARC record per page, without the end of record.

    A size counts the bytes of URL and payload, also of a payload that its record leaves out.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.col(url).cast("string"), r"[\r\n]", "%0A").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    rows = rows.withColumn("size", F.col("n") + F.coalesce(F.octet_length("url"), F.lit(0)))
    firsts = rows.filter(F.col("n") >= LEAST_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = small(materialise(firsts.filter("first < last").drop("last")))
    rows = rows.join(firsts, "digest", "left").withColumn("revisit", F.coalesce(F.expr("id > first"), F.lit(False)))
    urn = F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("payload")))
    captured = F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn),
        F.concat(F.lit("WARC-Date: "), captured),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_URN}"), "first", F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(lines, F.lit(END), block).alias("record"), "size")


def write_archives(pages: DataFrame, path: str, **columns: str) -> str:
    """Archives of ``pages`` below ``path``; a range of sizes that no page reaches costs no pass over them."""
    made = records(pages, **columns)
    most, low = made.agg(F.max("size")).first()[0] or 0, 0
    for high, count in SIZES:
        if low and most < low:
            break
        some = made.filter(F.col("size") >= low)
        some = some if high is None else some.filter(F.col("size") < high)
        writer = some.select("record").write.mode("append").option("lineSep", END)
        writer.option("maxRecordsPerFile", count).text(path)
        low = high
    return path


def url_key(url: str) -> str:
    """The URL with its host in reverse order, in lower case, without ``www`` and default ports."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return key + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number.lstrip("-").isdigit() else None


def parse(data: bytes, name: str) -> list[tuple]:
    """Index rows of one archive, in its own order."""
    rows, at = [], 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        begin, size = head + 4, int(fields["content-length"])
        block = memoryview(data)[begin : begin + size]
        cut = data.index(b"\r\n\r\n", begin, begin + size) + 4
        revisit = fields["warc-type"] == "revisit"
        if revisit:
            http = dict(line.split(": ", 1) for line in data[begin : cut - 4].decode().split("\r\n")[1:])
            length, digest = int(http["Content-Length"]), fields["warc-payload-digest"].removeprefix("sha256:")
        else:
            payload = block[cut - begin :]
            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        url = fields.get("warc-target-uri")
        end = begin + size + 4
        rows.append(
            (
                url_key(url) if url is not None else "",
                fields["warc-date"],
                _page(fields["warc-record-id"]),
                fields["warc-type"],
                length,
                digest,
                _page(fields.get("warc-refers-to")),
                name,
                at,
                end - at,
            )
        )
        at = end
    return rows


def sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = sorted(parse(data.as_py(), name), key=sort_key)
            if rows:
                yield _rows(rows)


_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of every archive below ``path``, each a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_runs, INDEX)


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """``(run, place)`` in key order over sorted runs of keys, by a tree of losers."""
    k = len(runs)
    place = [0] * k
    heads = [(0, r[0], i) if r else (1, None, i) for i, r in enumerate(runs)]
    tree = [-1] * k
    for i in range(k):
        winner, node = i, (i + k) // 2
        while node > 0:
            if tree[node] < 0:
                tree[node], winner = winner, -1
                break
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        if winner >= 0:
            tree[0] = winner
    while k and not heads[winner := tree[0]][0]:
        yield winner, place[winner]
        place[winner] += 1
        own = runs[winner]
        heads[winner] = (0, own[place[winner]], winner) if place[winner] < len(own) else (1, None, winner)
        node = (winner + k) // 2
        while node > 0:
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    archives = table.column("archive").combine_chunks().dictionary_encode()
    archives = archives.indices.to_numpy()
    keys = list(map(sort_key, zip(*(table.column(c).to_pylist() for c in _NAMES[:3]))))
    rows: list[list[int]] = [[] for _ in range(int(archives.max()) + 1)]
    for i in np.argsort(archives, kind="stable").tolist():
        rows[archives[i]].append(i)
    for own in rows:  # a run comes in order unless its part was fetched in several blocks
        own.sort(key=keys.__getitem__)
    order = [rows[r][p] for r, p in merged([[keys[i] for i in own] for own in rows])]
    out = table.take(pa.array(order)).combine_chunks()
    out = out.append_column("history_range", pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32)))
    yield from out.append_column("history_place", pa.array(np.arange(len(order), dtype=np.int64))).to_batches()


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order: by ``history_range``, then ``history_place``."""
    stored, n = materialise_counted(runs)
    ranges = max(1, -(-n // RANGE_ROWS))
    parts = stored.repartitionByRange(ranges, "url_key", "captured", "page_id")
    return parts.mapInArrow(_merge, INDEX + ", history_range int, history_place long")


def capture_history(pages: DataFrame, **columns: str) -> DataFrame:
    """Archives of ``pages`` in the scratch folder, read back as one merged capture history."""
    path = write_archives(pages, fresh_path(pages.sparkSession, "warc"), **columns)
    return merge_runs(read_runs(pages.sparkSession, path))
