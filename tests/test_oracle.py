"""Every registered query against its oracle SQL on the smallest data."""

import os

import pytest

from curatrix.plans.catalog import oracle_sql, queries
from curatrix.plans.registry import QUERIES
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, con, name):
    ok, message = compare(spark, con, name, SF_DIR)
    assert ok is not False, message


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    assert len(QUERIES) - len(oracle_sql()) <= 1
