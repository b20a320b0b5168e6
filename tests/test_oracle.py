"""Every registered query outside the training-data operators, against its SQL."""

from __future__ import annotations

import pytest

from spanloom.plans.queries import QUERIES
from spanloom.plans.sql import ALL_SQL
from tests.oracle import database, differences

DIR = "/root/testdata/sf0.001"
SQL = ALL_SQL


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DIR), SQL[name], con) == []


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
