import pytest

from flankline.plans import composed, surrogate
from tests.conftest import same


QUERIES, ORACLE_SQL = surrogate.QUERIES | composed.QUERIES, surrogate.ORACLE_SQL | composed.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
