"""Every registered query against its SQL, on whole small tables."""

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from mailtables.plans.queries import QUERIES

from compare import connect, difference, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    ours = spark_rows(entry.queries()[name](spark, SMALL))
    assert ours[1], "a query without rows checks nothing"
    assert difference(ours, duck_rows(duck, entry.oracle_sql()[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
