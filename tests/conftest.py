from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pageloom.operators.shred import shred  # noqa: E402
from pageloom.plans.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("pageloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """``page(html, ...)`` -> the shredded pages, numbered from 1 on ``http://host.example:8080/a/b``."""

    def make(*sources: str):
        rows = [(i, "http://host.example:8080/a/b", html) for i, html in enumerate(sources, 1)]
        return shred(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))

    return make


def rows(df, *columns):
    """Sorted plain tuples of the named columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
