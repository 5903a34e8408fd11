"""The cause cascade over literal records, one or more a branch, in the order in which branches decide."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyrun.operators import causes

def trace(**stages):
    return {"trace": {"stages": stages}}


def board(**more):
    return trace(job_board_discovery=more)


def searched(**search):
    return board(candidate_discovery={"sources": [{"source": "web", "trace": {"search": search}}]})


def opened(**opening):
    return {"error_code": "OPENING_DISCOVERY_INCOMPLETE"} | trace(opening_match=opening)


CANDIDATE = trace(career_discovery={"candidates": [{"url": "https://a.com/jobs/", "evidence_tier": "2"}], "candidate_fetch_errors": [{"url": "https://x.com", "retryable": True, "reason_code": "FETCH_FAILED"}, {"url": "https://a.com/jobs", "retryable": True, "reason_code": "TLS_FAILURE", "error": "SSL handshake"}]})
CASES = [
    ({"open_position_url": "https://a"}, "terminal|exact"), ({"trace": {"steps": [{"name": "match_opening", "availability_diagnostic": {"status": "verified_inventory_empty"}}]}}, "terminal|verified_no_match"),
    ({"error_code": "BOT_PROTECTION", "identity_assertion": {"provider": {"relationship_verified": True}}}, "terminal|external_blocked"), ({"error_code": "BOT_PROTECTION"}, "unclassified|BOT_PROTECTION"),
    ({"identity_assertion": {"failure_codes": ["B", "A", "", "B"]}} | CANDIDATE, "candidate_identity_rejected|A+B"), ({"error_code": "RESULT_IDENTITY_MISMATCH"}, "candidate_identity_rejected|RESULT_IDENTITY_MISMATCH"), ({"identity_assertion": {"verdict": "rejected"}}, "candidate_identity_rejected|identity_rejected"),
    (CANDIDATE, "correct_candidate_transport_failure|evidence_backed_career_tls"), ({"job_list_page_url": "u", "error_code": "READ_TIMEOUT", "trace": {"retry_events": [{"retryable": True, "reason_code": "FETCH_FAILED"}, {"retryable": True, "reason_code": "FETCH_FAILED", "transport_phase": "dns"}]}}, "correct_candidate_transport_failure|verified_job_list_dns"),
    (board(route_evaluation={"routes": {"provider_search": {"candidate_count": 2, "provider_verified_count": "1"}}}), "candidate_identity_rejected|provider_verified_hiring_relationship_unverified"),
    (trace(career_discovery={"search_discovery": {"stopped_reason": "deadline_exhausted", "queries": []}}), "budget_starvation|career_search_deadline_before_execution"), (searched(stopped_reason="deadline_exhausted", queries=[]), "budget_starvation|web_deadline_before_execution"),
    ({"error_code": "FETCH_BUDGET_EXHAUSTED", "stages": [{"stage": "a", "status": "success"}, {"stage": "b", "status": "partial"}]}, "budget_starvation|FETCH_BUDGET_EXHAUSTED"), (trace(career_discovery={"transport_budget": {"exhausted": True}}), "budget_starvation|transport_dispatch_budget_exhausted"),
    (board(candidate_verification={"x": {"rejected_candidates": [{"reason": "late"}, {"reason_code": "early"}, {}, 5]}, "y": 1}), "candidate_identity_rejected|candidate_rejected+early+late"),
    (searched(queries=[{"error": "x"}, {"response_disposition": "Blocked"}], candidates=[]), "linkedin_or_search_source_rejected|web:all_sources_rejected"),
    (board(candidate_coordinator={"routes": {"external_apply": {"status": "failed"}, "provider_search": {"failure": {"reason_code": "DNS_FAILURE"}}}}), "linkedin_or_search_source_rejected|external_apply:search_query_error+provider_search:DNS_FAILURE"),
    (searched(queries=[{"result_count": 3}], candidates=[]), "correct_candidate_not_produced|search_results_filtered_to_zero"), (searched(queries=[{}], candidates=[]), "correct_candidate_not_produced|executed_search_produced_no_results"),
    (searched(queries=[{}], candidates=[]) | {"job_list_page_url": "u"}, "unclassified|insufficient_causal_evidence"), ({"error_code": "JOB_BOARD_PORTFOLIO_INCOMPLETE"}, "correct_candidate_not_produced|eligible_board_portfolio_incomplete"),
    (opened(provider_api={"inventory": {"source": "js_declared_inventory", "complete": False}}), "correct_candidate_not_produced|js_declared_inventory_incomplete"),
    (opened(job_search_actions=[{"method": "get", "disposition": "eligible", "query_field": "q"}], generic_inventory=[{"stop_reason": "b"}, {"stop_reason": "a"}, {}]), "correct_candidate_not_produced|declared_get_inventory_a+b+unknown"),
    (opened(generic_inventory=[{"candidate_count": 2}]), "correct_candidate_not_produced|generic_partial_inventory_unknown"), (opened(job_search_actions=[{"disposition": "interactive_form"}]), "correct_candidate_not_produced|interactive_search_contract_unknown:interactive_form"),
    (opened(generic_inventory=[{"stop_reason": "single_page_unbounded"}], js_declared_inventory=[{"status": "transport_not_declared"}], job_list_url="https://J.com/x"), "unclassified|inventory_integration_unidentified:j.com"), (opened(), "unclassified|opening_inventory_incomplete_unknown"),
    ({}, "unclassified|insufficient_causal_evidence"), ({"trace": 5, "stages": "x", "identity_assertion": [1]}, "unclassified|insufficient_causal_evidence"),
]


def test_causes(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(CASES)] + [(99, None)], "k int, j string").withColumn("r", F.try_parse_json("j"))
    got = {r["k"]: r for r in causes.classify_causes(df, "r").drop("r").collect()}
    assert {k: f"{got[k]['category']}|{got[k]['trigger']}" for k in range(len(CASES))} == {k: want for k, (_, want) in enumerate(CASES)}
    assert got[99]["category"] == "unclassified" and got[12]["code_path"] == "b.budget_controller" and list(got[9]["bypasses"]) == ["provider_search"] and got[22]["confidence"] == "high"
    assert got[7]["evidence_paths"] == ["trace.stages.career_discovery.candidates", "trace.stages.career_discovery.candidate_fetch_errors"]
