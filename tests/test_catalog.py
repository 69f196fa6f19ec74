import os

import pytest

from oracle import compare, duck
from rolesift.plans.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_agrees_with_sql(spark, con, name):
    query, sql = CATALOG[name]
    ok, note = compare(spark, con, SF_DIR, name, query, sql)
    assert ok, note
