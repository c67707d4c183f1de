import pytest

from leafmill.plans import issuing, queries as plans  # noqa: F401
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, data, name):
    assert rows(plans.QUERIES[name](spark, data).toPandas()) == rows(connect(data).sql(plans.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["record_id", "leaf_count", "root", "reason"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
