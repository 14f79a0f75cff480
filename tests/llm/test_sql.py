import pytest

from tesserae.llm import queries

from ..oracle import differs


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert differs(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.01") is None
