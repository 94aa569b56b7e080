"""Every registered trajectory query against its SQL in DuckDB."""

import pytest
from oracle import compare, connect

from waystone.plans.queries import ORACLES, QUERIES, entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    said = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert said == "same" if name in ORACLES else said != "NO ROWS", said


def test_entry_is_stable(spark, sf_dir):
    assert entry(spark, sf_dir).columns == ["traveler_id", "n_points", "total_km", "threshold_km", "n_legs", "n_transfers"]
