import os

import pytest

from sparkchemo.plans.catalogue import ORACLE, QUERIES
from tests.oracle import assert_same, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(name, spark, con):
    assert_same(QUERIES[name](spark, FOLDER), ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(name, spark):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
