"""Every registered query equals its SQL; those without SQL run and give rows."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

ROOT = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    if name in SQL:
        assert difference(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_sql_has_no_stray_names():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "concern_count"
