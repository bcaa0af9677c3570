"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks.compare import connect, difference
from checks.queries import ORACLE, QUERIES
from conftest import SF

@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert difference(spark, duck, SF, name) is None


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
