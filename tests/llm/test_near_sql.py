"""Near duplicates against SQL over all pairs."""

import pytest

from aeolia.llm import near
from tests.comparing import of_duckdb, of_spark, tables


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_as_sql(spark, folder):
    assert of_spark(near.op6_near(spark, folder)) == of_duckdb(tables(folder), near.OP6_SQL)
