"""Every query against its SQL, or for its rows where SQL can't express it."""

import pytest
from comparing import duck_rows, spark_rows

from docstrata.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def same(found, wanted):
    return len(found) == len(wanted) and all(len(a) == len(b) and all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-6) for x, y in zip(a, b, strict=True)) for a, b in zip(found, wanted, strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck, small):
    names, found = spark_rows(QUERIES[name](spark, small))
    wanted_names, wanted = duck_rows(duck, SQL[name])
    assert names == wanted_names
    assert same(found, wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_and_schema(name, spark, small):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert len(df.collect()) > 0


def test_no_sql_without_query():
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
