import pytest

from listweave.plans import general_queries, list_queries
from oracle import check

EVERY = {**general_queries.QUERIES, **list_queries.QUERIES}
SQL = {**general_queries.ORACLE, **list_queries.ORACLE}


def test_every_query_has_sql():
    assert set(EVERY) == set(SQL)


@pytest.mark.parametrize("name", sorted(EVERY))
def test_query_equals_sql(spark, name):
    check(spark, EVERY[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["file", "source_idx", "line_no", "line"]
    assert set(EVERY) <= set(__spark_entry__.queries())
