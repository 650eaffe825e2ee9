"""Every registered query runs; those with SQL agree with DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import connect, same

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        df.write.format("noop").mode("overwrite").save()
        return
    _, problems = same(df, duck, sql)
    assert not problems
