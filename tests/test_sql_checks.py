"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, oracle_rows, rows_of

from quarrystone.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == oracle_rows(con, ORACLES[name])
