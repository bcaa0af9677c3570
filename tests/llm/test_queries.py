"""The registered queries against their SQL, and what the driver expects of them."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks import compare
from tallymill.llm.queries import ORACLE, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLE", ORACLE)
    assert compare.difference(spark, compare.connect(SF), SF, name) is None


def test_all_are_registered():
    registered = __spark_entry__.queries()
    assert all(registered[name] is query for name, query in QUERIES.items())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES
    assert all(__spark_entry__.oracle_sql()[name] == sql for name, sql in ORACLE.items())
