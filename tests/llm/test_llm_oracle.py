"""The queries for training data that have SQL give its rows; every one of the others runs on the small tables."""

import pytest
from conftest import same_rows

from cellweft.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, data_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, data_dir), duck, queries.SQL[name])


@pytest.mark.parametrize("name", ["p5_found", "p6_found", "p8_found"])
def test_query_runs(spark, data_dir, name):
    df = queries.QUERIES[name](spark, data_dir)
    assert df.count() == df.distinct().count()
