"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, folder, name):
    fn = entry.queries()[name]
    if name not in ORACLES:
        assert fn(spark, folder).count() > 0
        return
    problem, n = differences(spark, con, folder, fn, ORACLES[name])
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["parent_idx", "child_idx", "parent", "child", "degree"]
