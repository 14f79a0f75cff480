import pytest

from tesserae import queries

from .oracle import SMALL, differs

ALL, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert differs(spark, ALL[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, SMALL).count() > 0
