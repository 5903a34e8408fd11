"""Continuity rules, gates and employer matches on literals."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyrun.operators import continuity as C

SAME = {"provider": "lever", "tenant": "t", "canonical_board_url": "https://b.com/"}
GOOD = {
    "pipeline_status": "success", "output_validation_status": "success", "company_name": " Acme  inc", "open_position_url": "https://B.com:443/1/",
    "identity_assertion": {
        "verdict": "verified", "failure_codes": [], "location_classification": "exact", "candidate_opening_url": "https://u@b.com/1#x", "hiring": {"verified": True, "hiring_entity_name": "Acme", "source_company_name": "ACME INC"},
        "provider": SAME | {"relationship_verified": True, "hiring_entity_name": "acme"}, "opening": SAME | {"hiring_entity_name": "ACME", "canonical_opening_url": "https://b.com/1"},
        "selection": SAME | {"provider": " Lever ", "canonical_opening_url": "https://b.com/1?", "title": "Cook", "location": "Salem"},
    },
}
CASES = [
    ({}, []), ({"pipeline_status": None}, ["pipeline_not_success"]), ({"identity_assertion": []}, ["identity_assertion_missing"]), ({"identity_assertion.opening": None}, ["opening_identity_missing"]),
    ({"identity_assertion.hiring": 1, "output_validation_status": 5}, ["hiring_relationship_unverified", "output_validation_not_success"]), ({"identity_assertion.verdict": "rejected", "identity_assertion.failure_codes": ["X"]}, ["identity_failure_codes_present", "identity_not_verified"]),
    ({"identity_assertion.provider.relationship_verified": "true"}, ["provider_relationship_unverified"]), ({"identity_assertion.provider.provider": "unknown"}, ["provider_continuity_mismatch", "provider_not_typed"]),
    ({"identity_assertion.opening.tenant": ""}, ["tenant_missing"]), ({"identity_assertion.selection.tenant": "u"}, ["tenant_continuity_mismatch"]), ({"company_name": "other"}, ["source_company_continuity_mismatch"]),
    ({"open_position_url": "http://b.com/1"}, ["opening_url_continuity_mismatch", "opening_url_not_safe_public_https"]), ({"open_position_url": None}, ["opening_url_missing", "opening_url_not_safe_public_https"]),
    ({"identity_assertion.selection.location": " "}, ["selection_location_missing"]), ({"identity_assertion.selection.location": None, "identity_assertion.location_classification": "url_qualifier"}, []), ({"identity_assertion.location_classification": None}, ["location_not_verified"]),
]


def changed(changes):
    out = copy.deepcopy(GOOD)
    for path, value in changes.items():
        *way, last = path.split(".")
        at = out
        for k in way:
            at = at[k]
        at[last] = value
    return out


def test_continuity_issues(spark):
    rows = [(k, json.dumps(changed(c))) for k, (c, _) in enumerate(CASES)] + [(90, "7"), (91, None)]
    df = spark.createDataFrame(rows, "k int, j string").withColumn("r", F.try_parse_json("j"))
    got = {r["k"]: list(r["issues"]) for r in C.continuity_issues(df, "r").collect()}
    bare = ["identity_assertion_missing", "output_validation_not_success", "pipeline_not_success"]
    assert got == {k: want for k, (_, want) in enumerate(CASES)} | {90: bare, 91: bare}


@pytest.mark.parametrize(("sides", "issues"), [(([1, 2], [1, 2]), []), (([1, 2], [1]), ["b_count_differs", "keys_differ"]), (([1, 2], [1, 1]), ["keys_differ", "key_repeated"]), (([1, None], [1, None]), ["key_missing"]), (([], []), [])])
def test_measurement_gate(spark, sides, issues):
    a, b = (spark.createDataFrame([(k,) for k in s], "id int") for s in sides)
    assert list(C.measurement_gate({"a": a, "b": b}, "id").first()["issues"]) == issues


def test_employer_matches(spark):
    companies = spark.createDataFrame([(1, "The Acme Health Group"), (2, "acme, inc."), (3, "Acme Health West"), (4, ""), (5, None), (6, "Co"), (7, "Ac me")], "c int, n string")
    employers = spark.createDataFrame([("a", "ACME LLC", ["health"]), ("b", "Acme Health", None), ("c", "Company", ["x"]), ("d", "Health", ["acme"]), ("e", None, None)], "e string, m string, d array<string>")
    got = sorted(map(tuple, C.employer_matches(companies, "c", "n", employers, "e", "m", "d").collect()))
    assert got == [(1, "a", "prefix"), (1, "b", "equal"), (2, "a", "equal")]
