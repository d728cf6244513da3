"""Every registered query against its SQL on the smallest tables."""

from functools import cache

import pytest

import __spark_entry__ as contract
from contract import queries as Q
from contract.compare import connect, differences
from daytide.session import stage

SF = "/root/testdata/sf0.001"
QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """Build the feature table, z table, sequences and fit once for all queries here."""
    with pytest.MonkeyPatch.context() as patch:
        build = Q.features
        table = cache(lambda spark, sf, source="events": stage(build(spark, sf, source)))
        patch.setattr(Q, "features", table)
        patch.setattr(Q, "staged", table)
        for name in ("z_table", "sequences", "fitted"):
            patch.setattr(Q, name, cache(getattr(Q, name)))
        yield


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(con, df, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
