"""Queries over large groups keep one row of a group, not all of them in an array."""

from __future__ import annotations

import itertools

import pytest

from tallyrun.operators import ordered
from tallyrun.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["agg08_event_counts", "agg09_first_evidence", "win13_durable_fold"])
def test_no_array_of_a_group(spark, sf, name):
    assert "collect_list" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_durable_fold_equals_a_loop(spark):
    kinds = [("unresolved", None), ("unresolved", True), ("done", False), ("done", True), (None, False)]
    rows, want = [], {}
    for key, events in enumerate(e for n in range(1, 5) for e in itertools.product(kinds, repeat=n)):
        rows += [(key, o, v, a) for o, (v, a) in enumerate(events)]
        now = (events[0][0], 0)
        for o, (v, a) in enumerate(events[1:], 1):
            if a or now[0] == v == "unresolved":
                now = (v, o)
        want[key] = (*now, len(events) - 1)
    df = spark.createDataFrame(rows, "key long, o long, v string, a boolean")
    assert {r[0]: tuple(r)[1:] for r in ordered.durable_fold(df, "key", "o", "v", "a").collect()} == want
