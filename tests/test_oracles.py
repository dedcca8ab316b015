"""Every query of the library with SQL gives the SQL's rows on the small tables."""

import pytest
from compare import connect, differences

from scriptorium.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert differences(df, db, ORACLES[name]) == ""
    else:
        assert df.count() > 0
