"""Every registered query beside its SQL at the smallest scale."""

import pytest

from checks import QUERIES, SQL
from checks.compare import check, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = check(spark, con, SF_DIR, name)
    assert problem is None
    assert rows >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
