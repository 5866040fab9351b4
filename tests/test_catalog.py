"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__
from pagemill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert difference(df, duck, catalog.ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    flagship = __spark_entry__.entry(spark)
    assert flagship.columns == ["unit_id", "part_page", "part_seq", "n_pages", "n_regions", "markdown"]
