"""Captured pages and the URL lists that name them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.plans.session import spread

PAGE_COLUMNS = ("page_id", "url", "html")
GENERATED_ROWS = 10_000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages as ``page_id, url, html``; unread columns are pruned at the scan."""
    return spark.read.parquet(path).select(*PAGE_COLUMNS)


def pages_for_shredding(spark: SparkSession, path: str) -> DataFrame:
    """:func:`read_pages`, spread over all cores when the file has too few splits."""
    return spread(read_pages(spark, path), "page_id")


def page_by_url(pages: DataFrame, url: str) -> DataFrame:
    """Exactly the pages captured at ``url``; the predicate reaches the scan."""
    return pages.filter(F.col("url") == url)


def numbered_urls(spark: SparkSession, template: str, count: int, first: int = 1) -> DataFrame:
    """URLs from a ``%d`` template, generated on the executors: ``seq, url``."""
    return spark.range(first, first + count).select(
        F.col("id").alias("seq"), F.format_string(template, "id").alias("url")
    )


def listed_urls(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """URLs of a user's generator, in its order: ``seq, url``; for lists short enough for the driver."""
    return spark.createDataFrame(enumerate(urls, 1), "seq long, url string")


def generated_urls(
    seeds: DataFrame, column: str, generate: Callable[[str], Iterable[str]], rows: int = GENERATED_ROWS
) -> DataFrame:
    """URLs a Python generator yields for each seed, run on the executors: ``pos, url`` per seed row.

    They leave the worker ``rows`` at a time, those of several seeds together, so a seed may have any number of them in
    constant memory.
    """
    names = seeds.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            pos: list[int] = []
            made: list[str | None] = []

            def full() -> pa.RecordBatch:
                carried = batch.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [*carried.columns, pa.array(pos, pa.int64()), pa.array(made, pa.string())], [*names, "pos", "url"]
                )

            for r, seed in enumerate(batch.column(column)):
                for n, url in enumerate(generate(seed.as_py())):
                    at.append(r)
                    pos.append(n)
                    made.append(url)
                    if len(at) >= rows:
                        yield full()
                        at, pos, made = [], [], []
            if at:
                yield full()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema.fields)
    return seeds.mapInArrow(run, f"{kept}, pos long, url string")


def url_list(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """The listed URLs with their captured pages; uncaptured ones stay with NULL page columns."""
    return urls.join(pages, "url", "left")
