import pytest

from steadyline.plans import ORACLE_SQL, QUERIES

from .oracle import DATA, assert_same

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_names_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
