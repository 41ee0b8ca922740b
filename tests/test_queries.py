"""Every query with SQL against DuckDB; the others run and give rows."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points
from keystride.oracles import ORACLES
from keystride.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    assert compare(QUERIES[name](spark, sf), duck, ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns == [
        "session_id", "risk_score", "confidence", "tier", "factors"
    ]
