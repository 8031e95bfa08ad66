"""Every query with a SQL text against DuckDB on the smallest tables; the others must yield rows.

The full-size comparison is tools/check.py DIR.
"""

import pytest
from check import compare, connect

from knownwhen.plans import load_all

SF = "/root/testdata/sf0.001"
CATALOG = load_all()
# Nothing of these kinds is planted in the smallest tables.
MAY_BE_EMPTY = {"cluster_backfill", "range_conflicts", "common_window", "covariance_matrix", "annualised_vol", "portfolio_vol"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_matches_sql(spark, duck, name):
    q = CATALOG[name]
    status, got, want, _, _, note = compare(spark, duck, SF, name, q.run, q.oracle())
    fine = {"ok", "ROWS"} | ({"EMPTY"} if name in MAY_BE_EMPTY else set())
    assert status in fine, f"{name}: {status} spark={got} duck={want}{note}"
