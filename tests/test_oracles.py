"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF
from tests.oracle import compare, connect
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) is None


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["supplier_name", "total_amount", "invoices"]
    assert result.count() > 0
