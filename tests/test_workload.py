import pytest

from sparkloom import workload
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_matches_sql(name, spark, sf, con):
    oracle.assert_same(workload.QUERIES[name](spark, sf), con, workload.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES)))
def test_query_gives_rows(name, spark, sf):
    assert workload.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20
