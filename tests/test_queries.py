"""Every registered query of the invoice operators against DuckDB."""

import pytest

from oracle import assert_same
from tallyspark.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    assert_same(queries()[name](spark, SF), SF, oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracle_sql()) <= set(__spark_entry__.queries())
