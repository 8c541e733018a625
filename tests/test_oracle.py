"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check_oracle import compare, connect
from tablesync.workload.queries import REGISTRY


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(queries()) and set(REGISTRY) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SMOKE_DIR, name)
    assert ok, text


def test_entry(spark):
    assert entry(spark).count() > 0
