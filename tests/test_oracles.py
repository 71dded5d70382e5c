"""Every registered query of the reference operators beside its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tests.compare import connect, rows_of, rows_of_sql
from trustlake.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, con, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(con, ORACLES[name])


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
