"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import differences, duck

from supplyscope.registry import all_oracle_sql, all_queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = all_queries(), all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, SF_DIR).count() > 0
        return
    problem, _ = differences(spark, con, QUERIES[name], ORACLE[name], SF_DIR)
    assert problem is None
