"""Every query that SQL can express, against it."""

from __future__ import annotations

import pytest
from compare import connect, difference

from pagemill.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = connect(SF)
    assert difference(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) is None
    con.close()
