"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare

from tallyrun.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf) is None
