"""Every registered query against its SQL, over the smallest test tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, duck, SQL[name]) == []
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
