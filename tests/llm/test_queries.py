import pytest
from test_catalog import agree, views  # noqa: F401

from marlstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, views, name):  # noqa: F811
    agree(spark, views, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    from conftest import SMALL

    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()
