"""Why a record is unresolved, from its nested trace: an ordered cascade over VARIANT with typed defaults, and where in the trace each answer stands.

Traces have any shape; every step reads a member as the type that it asks for and takes a missing or other value as absent.  All of it is one projection in
stages, so what several causes ask of a trace is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.urls import host_of

# Reasons by what they speak of, origins that are trusted, outcomes of a search that show it was refused.
TRANSPORT_REASONS = ("FETCH_FAILED", "NETWORK_TIMEOUT", "DNS_FAILURE", "CONNECTION_FAILED", "TLS_FAILURE", "READ_TIMEOUT", "INCOMPLETE_READ", "PROVIDER_FETCH_FAILED")
BUDGET_REASONS = ("FETCH_BUDGET_EXHAUSTED", "COMPANY_TIME_BUDGET_EXHAUSTED", "OPENING_TIME_BUDGET_EXHAUSTED")
IDENTITY_REASONS = ("COMPANY_IDENTITY_AMBIGUOUS", "RESULT_IDENTITY_MISMATCH", "HIRING_RELATIONSHIP_UNVERIFIED", "TENANT_IDENTITY_MISMATCH")
BLOCKED_REASONS = ("BOT_PROTECTION", "CAPTCHA_REQUIRED", "HTTP_FORBIDDEN", "LOGIN_REQUIRED", "UNVERIFIABLE_THIRD_PARTY_HANDOFF")
NO_MATCH = ("verified_inventory_empty", "verified_inventory_no_match")
TRUSTED_ORIGINS = ("page_link", "verified_homepage_navigation", "stored_evidence", "linkedin_official_website")
REFUSED = ("challenge", "forbidden", "blocked", "fetch_failed")
ROUTES = ("external_apply", "provider_search", "website_career")
OLD_STEPS = {"career_discovery": "find_career_page", "job_board_discovery": "find_job_board", "opening_match": "match_opening"}


def _object(value: Column) -> Column:
    return F.when(V.members(value).isNotNull(), value)


def _text(value: Column) -> Column:
    """The text of a value, '' for none, false and zero."""
    text = F.coalesce(V.raw(value), F.lit(""))
    return F.when(text.isin("false", "0", "null"), "").otherwise(text)


def _count(value: Column) -> Column:
    return F.coalesce(V.raw(value).try_cast("double").cast("long"), F.lit(0))


def _true(value: Column) -> Column:
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & (V.raw(value) == "true"), F.lit(False))


def _list(value: Column) -> Column:
    """An array's objects; none for other values."""
    return F.filter(F.coalesce(V.elements(value), F.array().cast("array<variant>")), lambda x: V.members(x).isNotNull())


def _joined(texts: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(texts)), "+")


def _step(record: Column, name: str) -> Column:
    return F.get(F.filter(_list(V.member(record, "trace", "steps")), lambda s: V.raw(V.member(s, "name")) == name), F.lit(0))


def _stage(record: Column, stage: str) -> Column:
    """A stage's trace in the present form, else in the form of steps."""
    return F.coalesce(_object(V.member(record, "trace", "stages", stage)), _step(record, OLD_STEPS[stage]))


def _stripped(url: Column) -> Column:
    return F.regexp_replace(_text(url), "/+$", "")


def durable_outcome(record: Column) -> Column:
    """exact, verified_no_match, external_blocked or unresolved."""
    found = V.member(_step(record, "match_opening"), "availability_diagnostic")
    state = F.when(V.members(found).isNotNull(), F.coalesce(F.nullif(_text(V.member(found, "disposition")), F.lit("")), _text(V.member(found, "status")))).otherwise(_text(found))
    blocked = _text(V.member(record, "error_code")).isin(*BLOCKED_REASONS) & _true(V.member(record, "identity_assertion", "provider", "relationship_verified"))
    return F.when(_text(V.member(record, "open_position_url")) != "", "exact").when(state.isin(*NO_MATCH), "verified_no_match").when(blocked, "external_blocked").otherwise("unresolved")


def _refused(search: Column) -> Column:
    """Whether a search asked at least once and every query was refused without a result."""
    asked = _list(V.member(search, "queries"))
    lost = lambda q: (_count(V.member(q, "result_count")) <= 0) & ((_text(V.member(q, "error")) != "") | F.lower(_text(V.member(q, "response_disposition"))).isin(*REFUSED))
    return (F.size(asked) > 0) & F.forall(asked, lost)


def _cause(category: str | Column, trigger: Column, path: Column | str, paths: Sequence[str], confidence: str = "high") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(category).alias("category"), trigger.alias("trigger"), lit(path).alias("code_path"), lit(confidence).alias("confidence"), F.array(*map(F.lit, paths)).cast("array<string>").alias("evidence_paths"))


def _mechanism(opening: Column) -> list[tuple[Column, Column]]:
    """Why an opening's inventory stayed incomplete, in order."""
    at = "trace.stages.opening_match."
    inventory = V.member(opening, "provider_api", "inventory")
    actions, generic, stated = (_list(V.member(opening, k)) for k in ("job_search_actions", "generic_inventory", "js_declared_inventory"))
    stops = F.coalesce(F.nullif(_joined(F.transform(generic, lambda x: F.coalesce(F.nullif(_text(V.member(x, "stop_reason")), F.lit("")), F.lit("unknown")))), F.lit("")), F.lit("unknown"))
    most = F.coalesce(F.array_max(F.transform(generic, lambda x: _count(V.member(x, "candidate_count")))), F.lit(0))
    eligible = F.exists(actions, lambda a: (V.raw(V.member(a, "method")) == "get") & (V.raw(V.member(a, "disposition")) == "eligible") & (_text(V.member(a, "query_field")) != ""))
    asks = F.filter(actions, lambda a: _text(V.member(a, "disposition")).startswith("interactive_"))
    contracts = _joined(F.transform(asks, lambda a: F.concat(F.coalesce(F.nullif(_text(V.member(a, "method")), F.lit("")), F.lit("unknown")), F.lit(":"), _text(V.member(a, "disposition")))))
    unbounded = (F.size(generic) > 0) & F.forall(generic, lambda x: F.coalesce(V.raw(V.member(x, "stop_reason")) == "single_page_unbounded", F.lit(False)))
    silent = (F.size(stated) > 0) & F.forall(stated, lambda x: F.coalesce(V.raw(V.member(x, "status")) == "transport_not_declared", F.lit(False)))
    host = F.coalesce(F.nullif(host_of(V.raw(V.member(opening, "job_list_url"))), F.lit("")), F.lit("unknown_origin"))
    gap = "correct_candidate_not_produced"
    partial = (V.raw(V.member(inventory, "source")) == "js_declared_inventory") & (F.schema_of_variant(V.member(inventory, "complete")) == "BOOLEAN") & (V.raw(V.member(inventory, "complete")) == "false")
    return [
        (partial, _cause(gap, F.lit("js_declared_inventory_incomplete"), "opening_match.js_declared_inventory", [at + "provider_api.inventory"])),
        (eligible, _cause(gap, F.concat(F.lit("declared_get_inventory_"), stops), "opening_match.execute_declared_get_search", [at + "job_search_actions", at + "generic_inventory"])),
        (most > 0, _cause(gap, F.concat(F.lit("generic_partial_inventory_"), stops), "opening_match.generic_inventory_completeness", [at + "generic_inventory"])),
        (F.size(asks) > 0, _cause(gap, F.concat(F.lit("interactive_search_contract_"), contracts), "opening_match.declared_form_contract", [at + "job_search_actions"])),
        (unbounded & silent, _cause("unclassified", F.concat(F.lit("inventory_integration_unidentified:"), host), "opening_match.inventory_integration_identification", [at + "generic_inventory", at + "js_declared_inventory", at + "job_list_url"], "insufficient")),
        (F.lit(True), _cause("unclassified", F.concat(F.lit("opening_inventory_incomplete_"), stops), "opening_match.inventory_discovery", [at.rstrip(".")], "insufficient")),
    ]


def classify_causes(rows: DataFrame, record: str) -> DataFrame:
    """The rows with outcome, category, trigger, code_path, confidence, evidence_paths, bypasses and signature of a VARIANT record."""
    r = F.col(record)
    board = _stage(r, "job_board_discovery")
    df = rows.withColumns({"_reason": _text(V.member(r, "error_code")), "_career": _stage(r, "career_discovery"), "_board": board, "_opening": _stage(r, "opening_match"), "outcome": durable_outcome(r)})
    b, career = F.col("_board"), F.col("_career")
    discovery = F.coalesce(*[_object(V.member(b, *p)) for p in (("candidate_discovery",), ("candidate_route_probe", "candidate_discovery"), ("parallel_candidate_fallback", "candidate_discovery"))])
    search = lambda s: F.struct(F.coalesce(F.nullif(_text(V.member(s, "source")), F.lit("")), F.lit("candidate_source")).alias("source"), _object(V.member(s, "trace", "search")).alias("search"))
    codes = F.transform(F.coalesce(V.elements(V.member(r, "identity_assertion", "failure_codes")), F.array().cast("array<variant>")), _text)
    trusted = F.filter(_list(V.member(career, "candidates")), lambda c: V.raw(V.member(c, "origin")).isin(*TRUSTED_ORIGINS) | _count(V.member(c, "evidence_tier")).isin(1, 2))
    coordinator = F.coalesce(_object(V.member(b, "candidate_coordinator")), F.when(V.raw(V.member(b, "method")) == "candidate_discovery_coordinator_v2", b))
    df = df.withColumns({
        "_searches": F.filter(F.transform(_list(V.member(discovery, "sources")), search), lambda s: s["search"].isNotNull()),
        "_codes": F.array_sort(F.array_distinct(F.filter(codes, lambda c: c != ""))), "_trusted": F.transform(trusted, lambda c: _stripped(V.member(c, "url"))), "_coordinator": coordinator,
        "_stage": F.get(F.transform(F.filter(_list(V.member(r, "stages")), lambda s: V.raw(V.member(s, "status")).isin("failed", "partial", "unsupported")), lambda s: F.nullif(_text(V.member(s, "stage")), F.lit(""))), F.lit(0)),
    })
    reason, searches = F.col("_reason"), F.col("_searches")

    failed = F.filter(_list(V.member(career, "candidate_fetch_errors")), lambda e: _true(V.member(e, "retryable")) & (_stripped(V.member(e, "url")) != "") & F.array_contains("_trusted", _stripped(V.member(e, "url"))) & _text(V.member(e, "reason_code")).isin(*TRANSPORT_REASONS))
    said = lambda e: F.lower(_text(V.member(e, "error")))
    phase = lambda e: F.coalesce(F.nullif(_text(V.member(e, "transport_phase")), F.lit("")), F.when(said(e).rlike("ssl|tls"), "tls").when(said(e).rlike("timed out|timeout"), "timeout").when(said(e).rlike("dns|name or service"), "dns").otherwise("transport"))
    events = F.filter(_list(V.member(r, "trace", "retry_events")), lambda e: _true(V.member(e, "retryable")) & _text(V.member(e, "reason_code")).isin(*TRANSPORT_REASONS, *BUDGET_REASONS))
    phases = F.filter(F.transform(events, lambda e: _text(V.member(e, "transport_phase"))), lambda p: p != "")
    route = lambda name, key: _count(V.member(b, "route_evaluation", "routes", name, key))
    unverified = F.greatest(*[F.when((route(n, "candidate_count") > 0) & (route(n, "provider_verified_count") > 0) & (route(n, "relationship_verified_count") == 0), 1).otherwise(0) for n in ROUTES]) == 1
    starved = lambda s: (V.raw(V.member(s, "stopped_reason")) == "deadline_exhausted") & (F.size(V.elements(V.member(s, "queries"))) == 0)
    own_search = F.coalesce(starved(_object(V.member(career, "search_discovery"))), F.lit(False))
    starving = F.get(F.filter(searches, lambda s: F.coalesce(starved(s["search"]), F.lit(False))), F.lit(0))["source"]
    verification = F.coalesce(_object(V.member(b, "candidate_verification")), _object(V.member(F.col("_coordinator"), "candidate_verification")))
    rejected = F.flatten(F.transform(F.map_values(F.coalesce(V.members(verification), F.create_map().cast("map<string,variant>"))), lambda v: _list(V.member(v, "rejected_candidates"))))
    why = F.transform(rejected, lambda x: F.coalesce(F.nullif(_text(V.member(x, "reason_code")), F.lit("")), F.nullif(_text(V.member(x, "reason")), F.lit("")), F.lit("candidate_rejected")))

    def lost_route(name: str) -> Column:
        own = _object(V.member(F.col("_coordinator"), "routes", name))
        code, count = _text(V.member(own, "failure", "reason_code")), lambda *k: _count(V.member(own, *k))
        dead = (count("query_count") > 0) & (count("diagnostics", "query_error_count") >= count("query_count")) & (count("diagnostics", "raw_result_count") == 0) & (count("candidate_count") == 0)
        lost = own.isNotNull() & (code.isin(*TRANSPORT_REASONS, *BLOCKED_REASONS) | F.coalesce(V.raw(V.member(own, "status")) == "failed", F.lit(False)) | dead)
        return F.when(lost, F.concat(F.lit(name + ":"), F.coalesce(F.nullif(code, F.lit("")), F.lit("search_query_error"))))

    refused = F.transform(F.filter(searches, lambda s: _refused(s["search"])), lambda s: F.concat(s["source"], F.lit(":all_sources_rejected")))
    empty = F.filter(searches, lambda s: (F.size(V.elements(V.member(s["search"], "queries"))) > 0) & (F.size(V.elements(V.member(s["search"], "candidates"))) == 0) & ~_refused(s["search"]))
    results = lambda s: F.aggregate(_list(V.member(s["search"], "queries")), F.lit(0).cast("long"), lambda n, q: n + _count(V.member(q, "result_count")))
    bypass = [F.when(route(n, "candidate_count") > 0, n) for n in ROUTES[:2]]
    df = df.withColumns({
        "_phase": F.get(F.transform(failed, phase), F.lit(0)), "_event": F.get(phases, F.lit(0)), "_unverified": unverified, "_starving": F.when(own_search, "career_search").otherwise(starving), "_why": why,
        "_lost": F.array_sort(F.array_distinct(F.concat(refused, F.array_compact(F.array(*map(lost_route, ROUTES[:2])))))), "_results": F.get(F.transform(empty, results), F.lit(0)), "bypasses": F.array_compact(F.array(*bypass)),
    })
    listed, verdict = _text(V.member(r, "job_list_page_url")) != "", V.raw(V.member(r, "identity_assertion", "verdict"))
    rejected_whole = F.coalesce(verdict == "rejected", F.lit(False))
    at, spent = "trace.stages.job_board_discovery.", _true(V.member(career, "transport_budget", "exhausted"))
    sources = at + "candidate_discovery.sources[].trace.search."
    stage = F.coalesce("_stage", F.lit("unknown_stage"))
    known = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    cascade = [
        (F.col("outcome") != "unresolved", _cause("terminal", F.col("outcome"), "terminal_evidence", [])),
        (reason.isin(*IDENTITY_REASONS) | rejected_whole | (F.size("_codes") > 0), _cause("candidate_identity_rejected", known(F.coalesce(F.nullif(F.array_join("_codes", "+"), F.lit("")), reason), "identity_rejected"), F.when((reason == "RESULT_IDENTITY_MISMATCH") | rejected_whole, "result_validation.identity_gate").otherwise("website_resolution.company_identity_gate"), ["identity_assertion.verdict", "identity_assertion.failure_codes"])),
        (F.col("_phase").isNotNull(), _cause("correct_candidate_transport_failure", F.concat(F.lit("evidence_backed_career_"), "_phase"), "career_discovery.verify_evidence_backed_candidate", ["trace.stages.career_discovery.candidates", "trace.stages.career_discovery.candidate_fetch_errors"])),
        (listed & reason.isin(*TRANSPORT_REASONS), _cause("correct_candidate_transport_failure", F.concat(F.lit("verified_job_list_"), F.coalesce("_event", F.lit("transport"))), "opening_match.read_verified_inventory", ["job_list_page_url", "trace.retry_events", "identity_assertion.provider"])),
        (F.col("_unverified"), _cause("candidate_identity_rejected", F.lit("provider_verified_hiring_relationship_unverified"), "job_board_discovery.hiring_relationship_gate", [at + "route_evaluation"])),
        (F.col("_starving").isNotNull(), _cause("budget_starvation", F.concat("_starving", F.lit("_deadline_before_execution")), "job_board_discovery.candidate_route_budget", [sources + "queries", sources + "stopped_reason"])),
        (reason.isin(*BUDGET_REASONS) | spent, _cause("budget_starvation", F.when(reason.isin(*BUDGET_REASONS), reason).otherwise("transport_dispatch_budget_exhausted"), F.concat(stage, F.lit(".budget_controller")), ["stages[].reason_code"])),
        (F.size("_why") > 0, _cause("candidate_identity_rejected", _joined(F.col("_why")), "job_board_discovery.provider_candidate_verification", [at + "candidate_verification"])),
        (F.size("_lost") > 0, _cause("linkedin_or_search_source_rejected", F.array_join("_lost", "+"), "job_board_discovery.candidate_sources", [at + "candidate_discovery.sources"])),
        (~listed & F.col("_results").isNotNull(), _cause("correct_candidate_not_produced", F.when(F.col("_results") > 0, "search_results_filtered_to_zero").otherwise("executed_search_produced_no_results"), "job_board_discovery.provider_search_discovery", [sources + "queries", sources + "candidates"])),
        (reason == "JOB_BOARD_PORTFOLIO_INCOMPLETE", _cause("correct_candidate_not_produced", F.lit("eligible_board_portfolio_incomplete"), "job_board_discovery.portfolio_completeness_gate", [at + "job_board_portfolio"])),
        *[((reason == "OPENING_DISCOVERY_INCOMPLETE") & F.coalesce(test, F.lit(False)), cause) for test, cause in _mechanism(F.col("_opening"))],
        (F.lit(True), _cause("unclassified", known(reason, "insufficient_causal_evidence"), F.concat(F.coalesce("_stage", F.lit("pipeline")), F.lit(".unknown")), [], "insufficient")),
    ]
    chosen = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), cause) for test, cause in cascade])
    kept = [c for c in df.columns if not c.startswith("_") and c != "bypasses"]
    found = df.select(*kept, "bypasses", chosen.alias("_cause")).select(*kept, F.when(F.col("_cause.category") == "terminal", F.array().cast("array<string>")).otherwise(F.col("bypasses")).alias("bypasses"), "_cause.*")
    return found.withColumn("signature", F.concat_ws("|", "category", "trigger", "code_path"))
