import pytest

from auditloom.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
