"""Every registered query against its SQL, on the smallest data set."""

import pytest
from conftest import SMALL

import __spark_entry__ as spark_entry
import check


@pytest.fixture(scope="module")
def con():
    return check.database(SMALL)


def test_entry_runs(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["host", "link", "n"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query_matches_sql(spark, con, name):
    ok, note = check.compare(spark, con, SMALL, name)
    assert ok, note
