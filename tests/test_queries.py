import pytest
from compare import both

from boxloom.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, name):
    got, want = both(spark, Q.QUERIES[name], Q.ORACLES[name])
    assert got == want
