"""The registered queries against their SQL in DuckDB."""

import pytest
from oracle import compare, connect

from waystone.llm.oracles import ORACLES
from waystone.llm.queries import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, con, sf_dir, name):
    assert compare(spark, con, name, queries()[name], ORACLES[name], sf_dir) == "same"
