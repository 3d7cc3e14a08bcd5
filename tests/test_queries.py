import pytest

from aeolia.queries_plans import ORACLES, QUERIES
from tests.comparing import of_duckdb, of_spark, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert of_spark(QUERIES[name](spark, FOLDER)) == of_duckdb(con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
