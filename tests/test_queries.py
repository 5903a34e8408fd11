"""Every query of the reference's operators against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare

from tallyrun.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, ORACLES[name], sf) is None
    else:
        assert df.count() > 0
