import pytest
from differential import connect, differences

from lexarium import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert not differences(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])
