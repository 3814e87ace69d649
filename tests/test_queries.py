import pytest

from sparkveil.plans.catalogue import ORACLES, QUERIES

from oracle import SF, available, same

pytestmark = pytest.mark.skipif(not available(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(QUERIES) and set(__spark_entry__.oracle_sql()) >= set(ORACLES)
    assert __spark_entry__.entry(spark).columns == ["entity", "n", "best"]
