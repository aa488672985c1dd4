import pytest
from differential import connect, differences

from lexarium.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert not differences(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])
