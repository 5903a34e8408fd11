"""Run summaries: presence rates, funnels, ordered classifications, gated metrics, failure groups, route overlaps.

Every function takes DataFrames and column names and returns a DataFrame; counts come as integers next to their
denominators, ratios are plain quotients.  Empty strings count as absent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import numbered

# The stages in order, statuses that fail, and outcomes by rank.
STAGES = ("linkedin_discovery", "website_resolution", "hiring_identity_resolution", "career_discovery", "job_board_discovery", "opening_match", "result_validation")
FAILING = ("failed", "partial", "unsupported")
OUTCOMES = (
    "exact_opening", "verified_no_match", "no_public_openings", "identity_ambiguous", "retryable_failure", "linkedin_native_only",
    "external_blocked", "replay_infrastructure_failure", "unsupported_capability", "discovery_unresolved", "source_closed", "other_non_success",
)
BLOCKED_REASONS = ("BOT_PROTECTION", "CAPTCHA_REQUIRED", "HTTP_FORBIDDEN", "LOGIN_REQUIRED", "UNVERIFIABLE_THIRD_PARTY_HANDOFF")
REPLAY_REASONS = ("OFFLINE_FIXTURE_MISSING", "OFFLINE_TAPE_DIVERGENCE")
UNSUPPORTED_REASONS = ("PROVIDER_UNKNOWN", "PROVIDER_UNSUPPORTED", "PROVIDER_VARIANT_UNSUPPORTED")
UNRESOLVED_REASONS = ("CAREER_PAGE_NOT_FOUND", "EMPTY_PROVIDER_RESPONSE", "JOB_BOARD_NOT_FOUND", "LOCATION_MISMATCH", "OPENING_DISCOVERY_INCOMPLETE", "OPENING_NOT_FOUND", "TITLE_MISMATCH", "WEBSITE_NOT_RESOLVED")
INCOMPLETE_PRIORITY = {
    "CAPTCHA_REQUIRED": 100, "OFFLINE_FIXTURE_MISSING": 98, "LOGIN_REQUIRED": 95, "BOT_PROTECTION": 90, "HTTP_FORBIDDEN": 85, "RATE_LIMITED": 80,
    "COMPANY_TIME_BUDGET_EXHAUSTED": 75, "FETCH_BUDGET_EXHAUSTED": 74, "NETWORK_TIMEOUT": 70, "DNS_FAILED": 65, "CONNECTION_FAILED": 60, "SERVER_ERROR": 55,
    "PARSING_FAILED": 50, "INVALID_STRUCTURED_DATA": 49, "PROVIDER_VARIANT_UNSUPPORTED": 45, "PROVIDER_UNSUPPORTED": 44, "PROVIDER_UNKNOWN": 43,
    "PROVIDER_FETCH_FAILED": 40, "FETCH_FAILED": 35,
}
NAMES_SHOWN = 20


def present(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def cascade(rules: Sequence[tuple[Column, str | int | None]], otherwise: str | int | None = None) -> Column:
    """The value of the first rule that holds; null tests do not hold."""
    out = None
    for test, value in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def first_present(*columns: str | Column) -> Column:
    return F.coalesce(*[F.when(present(c), F.col(c) if isinstance(c, str) else c) for c in columns])


def presence_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column: metric, n_present, denominator (all rows, 1 at least) and rate."""
    counts = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), *[F.count_if(present(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"c{i}").alias("n_present")) for i, c in enumerate(columns)]))
    return counts.select("n", rows.alias("r")).select("r.metric", "r.n_present", F.col("n").alias("denominator"), (F.col("r.n_present") / F.col("n")).alias("rate"))


def stage_funnel(records: DataFrame, stage_rows: DataFrame, key: str, stage: str, status: str, stages: Sequence[str]) -> DataFrame:
    """stage, ord, status, n over every record and each fixed stage; a record without a row for a stage is ``not_recorded``.

    One pass over either table: the stages of a key lie side by side, so records join a row each.  A record counts once a stage, by its smallest status.
    """
    wide = stage_rows.filter(F.col(stage).isin(*stages)).groupBy(F.col(key).alias("k")).agg(*[F.min(F.when(F.col(stage) == s, F.col(status))).alias(f"s{i}") for i, s in enumerate(stages)])
    each = records.select(F.col(key).alias("k")).distinct().join(wide, "k", "left")
    cells = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("ord"), F.coalesce(f"s{i}", F.lit("not_recorded")).alias("status")) for i, s in enumerate(stages)])
    return each.select(F.explode(cells).alias("c")).groupBy("c.stage", "c.ord", "c.status").agg(F.count("*").alias("n"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def reason_counts(stage_rows: DataFrame, reason: str, *keys: str) -> DataFrame:
    """Counts of present reasons, by more keys if given."""
    return stage_rows.filter(present(reason)).groupBy(*keys, reason).agg(F.count("*").alias("n"))


def exploded_counts(df: DataFrame, array: str, *fields: str) -> DataFrame:
    """Counts over the structs of a nested array by some of their fields."""
    return df.select(F.explode(array).alias("e")).groupBy(*[F.col(f"e.{f}").alias(f) for f in fields]).agg(F.count("*").alias("n"))


def first_matching(array: Column, test) -> Column:
    """The first element of an array that passes ``test``, else null."""
    return F.get(F.filter(array, test), F.lit(0))


def first_evidence_counts(df: DataFrame, evidence: str, kind: str, field: str) -> DataFrame:
    """Per record the first evidence item of a kind, counted by one of its fields."""
    first = first_matching(F.col(evidence), lambda e: e["kind"] == kind)
    return df.select(first.getField(field).alias(field)).filter(present(field)).groupBy(field).agg(F.count("*").alias("n"))


def stage_matrix(stage_rows: DataFrame, key: str, stage: str, value: Column, stages: Sequence[str]) -> DataFrame:
    """One row per record and one column per stage; the stages are given, so no pass over the data finds them."""
    return stage_rows.groupBy(key).pivot(stage, list(stages)).agg(value)


def durations(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], skip: Column | None = None) -> DataFrame:
    """n and nearest-rank percentiles (element ceil(p n) of the sorted values) by key."""
    rows = df.filter(F.col(value).isNotNull())
    rows = rows if skip is None else rows.filter(~F.coalesce(skip, F.lit(False)))
    percentile = [F.expr(f"percentile_disc({p}) within group (order by `{value}`)").cast("bigint").alias(n) for n, p in shares.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *percentile)


def gated_metrics(df: DataFrame, metrics: Sequence[tuple], scopes: Mapping[str, Column] | None = None) -> DataFrame:
    """metric, status, numerator, denominator, unknown_count, value of every (name, numerator, denominator, unknown[, gated]); with ``scopes``
    each once a scope, over the rows where its condition holds.  One aggregate over ``df`` gives them all.

    ``available`` only if nothing is unknown and, where ``gated``, the denominator is over 0; value is null unless available with a denominator over 0.
    """
    aggs, cells = [], []
    for scope, inside in (scopes or {None: F.lit(True)}).items():
        for name, numerator, denominator, unknown, *gated in metrics:
            n, d, u = (f"{kind}{len(cells)}" for kind in "ndu")
            aggs += [F.count_if(inside & numerator & denominator).alias(n), F.count_if(inside & denominator).alias(d), F.count_if(inside & unknown).alias(u)]
            open_ = (F.col(u) == 0) & ((F.col(d) > 0) if gated and gated[0] else F.lit(True))
            cells.append(F.struct(
                *([F.lit(scope).alias("scope")] if scopes else []), F.lit(name).alias("metric"), F.when(open_, "available").otherwise("not_reportable").alias("status"), F.col(n).alias("numerator"),
                F.col(d).alias("denominator"), F.col(u).alias("unknown_count"), F.when(open_ & (F.col(d) > 0), F.try_divide(F.col(n), F.col(d))).alias("value"),
            ))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def annotation_metrics(records: DataFrame, scopes: Mapping[str, Column] | None = None) -> DataFrame:
    """Precision, recall and defect rate of records (has_opening, annotated, verdict, eligible as text, defect)."""
    missing, verified = ~F.col("annotated"), F.coalesce(F.col("verdict") == "verified", F.lit(False))
    reviewed, exact, eligible = F.coalesce(F.col("verdict").isin("verified", "rejected"), F.lit(False)), F.coalesce("has_opening", F.lit(False)), F.coalesce(F.col("eligible") == "true", F.lit(False))
    return gated_metrics(records, [
        ("precision", verified, exact & reviewed, missing | (exact & ~reviewed)), ("recall", exact & verified, eligible, missing, True),
        ("defect_rate", F.coalesce("defect", F.lit(False)), F.lit(True), missing),
    ], scopes)


def terminal_stage(stages: Column) -> Column:
    """Of an array of stage structs in order: any native-only one first, else the last that fails with a reason; else null."""
    failing = F.filter(stages, lambda s: s["status"].isin(*FAILING) & s["reason_code"].isNotNull())
    native = first_matching(failing, lambda s: s["reason_code"] == "LINKEDIN_NATIVE_ONLY")
    return F.coalesce(native, F.try_element_at(failing, F.lit(-1)))


def terminal_outcome(opening_url: Column, disposition: Column, closed: Column, stages: Column, relationship: Column) -> Column:
    """The record's one outcome, by the first rule that holds."""
    stage = terminal_stage(stages)
    reason = stage["reason_code"]
    blocked = reason.isin(*BLOCKED_REASONS)
    return cascade(
        [
            (present(opening_url), "exact_opening"),
            (disposition.isin("verified_inventory_no_match", "verified_inventory_empty"), "verified_no_match"),
            (closed, "source_closed"),
            (stage.isNull(), "other_non_success"),
            (reason == "NO_PUBLIC_OPENINGS", "no_public_openings"),
            (reason.isin("COMPANY_IDENTITY_AMBIGUOUS", "OPENING_IDENTITY_AMBIGUOUS"), "identity_ambiguous"),
            (stage["retryable"], "retryable_failure"),
            (reason == "LINKEDIN_NATIVE_ONLY", "linkedin_native_only"),
            (blocked & relationship, "external_blocked"),
            (blocked, "discovery_unresolved"),
            (reason.isin(*REPLAY_REASONS), "replay_infrastructure_failure"),
            ((stage["status"] == "unsupported") | reason.isin(*UNSUPPORTED_REASONS), "unsupported_capability"),
            (reason.isin(*UNRESOLVED_REASONS), "discovery_unresolved"),
            (reason == "OPENING_CLOSED", "source_closed"),
        ],
        "other_non_success",
    )


def outcome_rank(outcome: Column) -> Column:
    return F.element_at(F.create_map(*[x for i, o in enumerate(OUTCOMES) for x in (F.lit(o), F.lit(i))]), outcome)


def pipeline_status(validation: Column, opening: Column, board: Column, career: Column, any_partial: Column, any_unsupported: Column) -> Column:
    return cascade(
        [
            (validation.isin("failed", "unsupported"), "failed"),
            (opening == "success", "success"),
            ((board == "success") & (opening == "partial"), "partial"),
            (board == "success", "success"),
            ((career == "success") | any_partial, "partial"),
            (any_unsupported, "unsupported"),
        ],
        "failed",
    )


def first_missing(steps: Mapping[str, str]) -> Column:
    """The name of the first step whose column is absent; null when all are there."""
    return cascade([(~present(c), name) for name, c in steps.items()])


def failure_groups(stage_rows: DataFrame, company: str = "company", names_shown: int = NAMES_SHOWN) -> DataFrame:
    """Failing stage rows grouped by (stage, provider, reason), each company counted once.

    A company is retryable if any of its rows is, and counts under its outcome of the lowest rank.  Names come sorted, the first
    ``names_shown``; the bound is the report's.  Columns: stage, ord, provider, reason_code, company_count, retryable_count, best_outcome, names.
    """
    rows = stage_rows.filter(F.col("status").isin(*FAILING) & present("reason_code"))
    each = rows.groupBy("stage", "ord", "provider", "reason_code", F.col(company).alias("company")).agg(F.max("retryable").alias("retryable"), F.min("outcome_rank").alias("outcome_rank"))
    keys = ["stage", "ord", "provider", "reason_code"]
    groups = each.groupBy(*keys).agg(F.count("*").alias("company_count"), F.count_if("retryable").alias("retryable_count"), F.min("outcome_rank").alias("best_outcome"))
    order = Window.partitionBy(*keys).orderBy(F.lower("company"), "company")
    names = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= names_shown)
    names = names.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "company"))), lambda x: x["company"]).alias("names"))
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    return groups.alias("g").join(names.alias("n"), same).select("g.*", "n.names")


def route_mask(routes: Mapping[str, Column]) -> Column:
    """Bit i is set where route i holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(routes.values())])


def route_overlap(rows: DataFrame, key: str, mask: str, routes: int) -> DataFrame:
    """mask and n of records by their or-ed mask, every one of the 2^routes cells present."""
    cells = rows.sparkSession.range(1 << routes).select(F.col("id").cast("int").alias("mask"))
    each = rows.groupBy(key).agg(F.bit_or(mask).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    return cells.join(each, "mask", "left").select("mask", F.coalesce("n", F.lit(0)).alias("n"))


def route_funnel(rows: DataFrame, route: str, steps: Sequence[str]) -> DataFrame:
    """Per route and step: passed (all steps up to it hold) and its denominator, the count of the step before (first: all rows)."""
    passed, aggs = F.lit(True), [F.count("*").alias("total")]
    for s in steps:
        passed = passed & F.coalesce(F.col(s), F.lit(False))
        aggs.append(F.count_if(passed).alias(s))
    found = rows.groupBy(route).agg(*aggs)
    before = ["total", *steps]
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(i).alias("ord"), F.col(s).alias("passed"), F.col(before[i]).alias("denominator")) for i, s in enumerate(steps)]))
    return found.select(route, cells.alias("c")).select(route, "c.*")


def signature_clusters(rows: DataFrame, signature: Sequence[str], company: str, least: int) -> DataFrame:
    """Groups by signature with n, distinct companies, qualified (``least`` companies and over) and rank."""
    found = rows.groupBy(*signature).agg(F.count("*").alias("n"), F.countDistinct(company).alias("companies"))
    found = found.withColumn("qualified", F.col("companies") >= least)
    ranked = numbered(found, [~F.col("qualified"), F.desc("companies"), *[F.col(c) for c in signature]], "cluster_rank")
    return ranked.withColumn("cluster_rank", F.col("cluster_rank").cast("int"))


def cause_of(transport: Column, budget: Column, identity: Column, inventory: Column, reason: Column) -> Column:
    """A record's cause: transport, budget, identity, inventory, the reason as it stands, or unknown."""
    return F.coalesce(cascade([(transport, "transport"), (budget, "budget"), (identity, "identity"), (inventory, "inventory")]), F.when(present(reason), F.lower(reason)), F.lit("unknown"))


def count_map(df: DataFrame, key: str) -> DataFrame:
    """All counts as one map, keys sorted."""
    pairs = df.filter(present(key)).groupBy(key).agg(F.count("*").alias("n"))
    return pairs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), "n")))).alias("counts"))


def blockers(df: DataFrame, thresholds: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """The names of aggregates below their threshold, as one sorted array."""
    found = df.agg(*[agg.alias(f"c{i}") for i, (agg, _) in enumerate(thresholds.values())])
    tests = [F.when(F.coalesce(F.col(f"c{i}") < least, F.lit(True)), name) for i, (name, (_, least)) in enumerate(thresholds.items())]
    return found.select(F.sort_array(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("blockers"))


def availability(closed: Column, ambiguous: Column, errors: Column, complete: Column, count: Column) -> Column:
    return cascade(
        [(closed, "source_posting_closed"), (ambiguous, "identity_ambiguous"), (errors, "inventory_incomplete"), (complete & (count == 0), "verified_inventory_empty"), (complete, "verified_inventory_no_match")],
        "inventory_incomplete",
    )


def worst_reason(reasons: Column) -> Column:
    """Of an array of reason codes the one of the highest priority; ties by name, unknown ones last."""
    table = F.create_map(*[x for k, p in INCOMPLETE_PRIORITY.items() for x in (F.lit(k), F.lit(p))])
    ranked = F.transform(F.filter(reasons, lambda r: r.isNotNull()), lambda r: F.struct((-F.coalesce(F.try_element_at(table, r), F.lit(0))).alias("p"), r.alias("r")))
    return F.array_min(ranked)["r"]


def merged_errors(rows: DataFrame, keys: Sequence[str], ordinal: str, provenance: str) -> DataFrame:
    """Equal errors once, at their first ordinal, with the sorted distinct provenance."""
    return rows.groupBy(*keys).agg(F.min(ordinal).alias("first_ordinal"), F.count("*").alias("n"), F.array_sort(F.collect_set(provenance)).alias("provenance"))


def by_priority(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the value that comes first in ``order``; values not listed come last, by name."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]), F.col(value)), F.lit(len(order)))
    return rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), F.col(value).alias(value))).alias("m")).select(*keys, f"m.{value}")


def accuracy(rows: DataFrame, expected: str, actual: str, rejects: str | None = None) -> DataFrame:
    """n, correct, wrong and missing; a value among ``rejects`` (an array column) counts as must_reject."""
    exp, act = F.col(expected), F.col(actual)
    bad = F.array_contains(rejects, act) if rejects else F.lit(False)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(act == exp).alias("correct"), F.count_if(act.isNotNull() & (act != exp)).alias("wrong"),
        F.count_if(act.isNull()).alias("missing"), F.count_if(F.coalesce(bad, F.lit(False))).alias("must_reject"),
    )


def master_summary(spark: SparkSession, records: DataFrame, columns: Sequence[str], status: str) -> DataFrame:
    """section, name, n: records, presence and statuses in one table."""
    total = records.agg(F.count("*").alias("n")).select(F.lit("records").alias("section"), F.lit("total").alias("name"), "n")
    rates = presence_rates(records, columns).select(F.lit("present").alias("section"), F.col("metric").alias("name"), F.col("n_present").alias("n"))
    statuses = counts_by(records, status).select(F.lit("status").alias("section"), F.coalesce(status, F.lit("not_recorded")).alias("name"), "n")
    return total.unionByName(rates).unionByName(statuses)
