"""Queries over continuity rules, measurement gates and employer matches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import continuity as C
from ..operators.causes import classify_causes
from ..operators.shared import spread
from .tables import table


def _record() -> Column:
    """An order as a result record as JSON; orders break rules as their keys say."""
    k = F.col("o_orderkey")
    board, url = F.concat(F.lit("https://b.com/"), "o_custkey"), F.concat(F.lit("https://b.com/"), "o_custkey", F.lit("/"), k)
    part = lambda **more: F.struct(F.lit("lever").alias("provider"), F.concat(F.lit("t"), "o_custkey").alias("tenant"), board.alias("canonical_board_url"), *[v.alias(n) for n, v in more.items()])
    entity = F.concat(F.lit("Firm  "), "o_custkey")
    hiring = F.struct((k % 5 != 1).alias("verified"), entity.alias("hiring_entity_name"), F.lit("ACME").alias("source_company_name"))
    provider = part(relationship_verified=F.lit(True), hiring_entity_name=F.upper(F.regexp_replace(entity, " +", " ")))
    opening = F.when(k % 7 != 2, part(hiring_entity_name=F.when(k % 11 == 3, F.lit("other")).otherwise(entity), canonical_opening_url=F.concat(url, F.when(k % 13 == 4, F.lit("/x")).otherwise(F.lit("/")))))
    selection = part(canonical_opening_url=url, title=F.when(k % 17 == 5, F.lit(" ")).otherwise(F.col("o_orderpriority")), location=F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("Salem")))
    place = F.when(k % 2 == 0, "url_qualifier").when(k % 19 == 6, "mismatch").otherwise("exact")
    assertion = F.struct(F.lit("verified").alias("verdict"), F.array().cast("array<string>").alias("failure_codes"), hiring.alias("hiring"), provider.alias("provider"), opening.alias("opening"), selection.alias("selection"), url.alias("candidate_opening_url"), place.alias("location_classification"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success")
    return F.to_json(F.struct(status.alias("pipeline_status"), F.lit("success").alias("output_validation_status"), F.lit("acme").alias("company_name"), url.alias("open_position_url"), F.when(k % 23 != 7, assertion).alias("identity_assertion")))


def cmp05_continuity_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "orders")).select("o_orderkey", F.try_parse_json(_record()).alias("record"))
    return C.continuity_issues(rows, "record").drop("record")


def cmp07_measurement_gate(spark: SparkSession, d: str) -> DataFrame:
    """Customers, the customers of orders (some repeated, some without one) and their first orders as cohort, trace and results."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return C.measurement_gate({"cohort": table(spark, d, "customer"), "trace": orders, "results": orders.select("c_custkey").distinct()}, "c_custkey")


def joi22_employer_matches(spark: SparkSession, d: str) -> DataFrame:
    """Parts as companies (two words and their type), and each first word, with the second words that it publishes, and each whole name as employers."""
    parts = table(spark, d, "part")
    companies = parts.select("p_partkey", F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" "), "p_type", F.lit(" Inc.")).alias("name"))
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    short = parts.where("p_size % 2 = 0").groupBy(first.alias("employer")).agg(F.array_distinct(F.flatten(F.collect_set(F.array(second, F.lit("economy"), F.lit("small"))))).alias("terms"))
    whole = parts.groupBy(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" group")).alias("employer")).agg(F.array(F.lit("unused")).alias("terms"))
    employers = short.unionByName(whole).withColumn("title", F.col("employer"))
    return C.employer_matches(companies, "p_partkey", "name", employers, "employer", "title", "terms")


def _traced() -> Column:
    """An order as a record with a trace as JSON text; its cause follows from its key."""
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    forms = [
        F.concat(F.lit('{"error_code":"FETCH_BUDGET_EXHAUSTED","stages":[{"stage":"s'), F.col("o_orderstatus"), F.lit('","status":"partial"}]}')),
        F.concat(F.lit('{"trace":{"stages":{"job_board_discovery":{"candidate_verification":{"x":{"rejected_candidates":[{"reason":"'), priority, F.lit('"},{"reason":"z"}]}}}}}}')),
        F.concat(F.lit('{"trace":{"stages":{"job_board_discovery":{"candidate_discovery":{"sources":[{"source":"web","trace":{"search":{"candidates":[],"queries":[{"result_count":'), (F.col("o_orderkey") % 2).cast("string"), F.lit("}]}}}]}}}}}")),
        F.concat(F.lit('{"error_code":"OPENING_DISCOVERY_INCOMPLETE","trace":{"stages":{"opening_match":{"generic_inventory":[{"candidate_count":'), (F.col("o_orderkey") % 4).cast("string"), F.lit(',"stop_reason":"'), F.col("o_orderstatus"), F.lit('"}]}}}}')),
        F.concat(F.lit('{"open_position_url":"https://a.com/'), key, F.lit('"}')), F.concat(F.lit('{"identity_assertion":{"failure_codes":["'), F.col("o_orderstatus"), F.lit('","A"]}}')), F.lit('{"trace":'),
    ]
    return F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))


def agg27_causes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.try_parse_json(_traced()).alias("record"))
    return classify_causes(rows, "record").select("o_orderkey", "outcome", "category", "trigger", "code_path", "confidence")


def agg26_cause_signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.try_parse_json(_traced()).alias("record"))
    found = classify_causes(rows, "record").where("outcome = 'unresolved'").select("o_custkey", "signature").groupBy("o_custkey", "signature").agg(F.count("*").alias("n"))
    return found.groupBy("signature").agg(F.sum("n").alias("records"), F.count("*").alias("companies"))


QUERIES = {f.__name__: f for f in (cmp05_continuity_issues, cmp07_measurement_gate, joi22_employer_matches, agg27_causes, agg26_cause_signatures)}

_CAUSES = """
select o_orderkey, o_custkey, case k when 4 then 'exact' else 'unresolved' end as outcome,
  case when k = 0 then 'budget_starvation' when k in (1, 5) then 'candidate_identity_rejected' when k = 2 or (k = 3 and o_orderkey % 4 > 0) then 'correct_candidate_not_produced' when k = 4 then 'terminal' else 'unclassified' end as category,
  case k when 0 then 'FETCH_BUDGET_EXHAUSTED' when 1 then o_orderpriority || '+z' when 2 then case when o_orderkey % 2 = 1 then 'search_results_filtered_to_zero' else 'executed_search_produced_no_results' end
    when 3 then case when o_orderkey % 4 > 0 then 'generic_partial_inventory_' else 'opening_inventory_incomplete_' end || o_orderstatus when 4 then 'exact' when 5 then 'A+' || o_orderstatus else 'insufficient_causal_evidence' end as trigger,
  case k when 0 then 's' || o_orderstatus || '.budget_controller' when 1 then 'job_board_discovery.provider_candidate_verification' when 2 then 'job_board_discovery.provider_search_discovery'
    when 3 then case when o_orderkey % 4 > 0 then 'opening_match.generic_inventory_completeness' else 'opening_match.inventory_discovery' end when 4 then 'terminal_evidence'
    when 5 then 'website_resolution.company_identity_gate' else 'pipeline.unknown' end as code_path,
  case when k = 6 or (k = 3 and o_orderkey % 4 = 0) then 'insufficient' else 'high' end as confidence from (select *, o_orderkey % 7 as k from orders)"""

ORACLES = {
    "agg27_causes": f"select * exclude (o_custkey) from ({_CAUSES})",
    "agg26_cause_signatures": f"""
select category || '|' || trigger || '|' || code_path as signature, count(*) as records, count(distinct o_custkey) as companies from ({_CAUSES}) where category <> 'terminal' group by 1""",
    "cmp05_continuity_issues": """
select o_orderkey, list_sort(list_filter([case when o_orderstatus = 'F' then 'pipeline_not_success' end, case when k % 23 = 7 then 'identity_assertion_missing' end,
  case when k % 23 <> 7 and k % 5 = 1 then 'hiring_relationship_unverified' end, case when k % 23 <> 7 and k % 7 = 2 then 'opening_identity_missing' end,
  case when whole and k % 11 = 3 then 'hiring_entity_continuity_mismatch' end, case when whole and k % 13 = 4 then 'opening_url_continuity_mismatch' end,
  case when whole and k % 17 = 5 then 'selection_title_missing' end, case when whole and k % 3 = 0 and k % 2 = 1 then 'selection_location_missing' end,
  case when whole and k % 2 = 1 and k % 19 = 6 then 'location_not_verified' end], lambda x: x is not null)) as issues
from (select *, o_orderkey as k, o_orderkey % 23 <> 7 and o_orderkey % 7 <> 2 as whole from orders)""",
    "cmp07_measurement_gate": """
with c as (select count(*) as n from customer), o as (select count(*) as n, count(distinct o_custkey) as k from orders),
p as (select count(*) as n from customer full join (select distinct o_custkey from orders) on c_custkey = o_custkey where c_custkey is null or o_custkey is null),
r as (select count(*) as n from (select o_custkey from orders group by 1 having count(*) > 1))
select c.n as n_cohort, o.n as n_trace, o.k as n_results, p.n as n_partial, r.n as n_repeated, 0 as n_null,
  list_filter([case when o.n <> c.n then 'trace_count_differs' end, case when o.k <> c.n then 'results_count_differs' end, case when p.n > 0 then 'keys_differ' end, case when r.n > 0 then 'key_repeated' end], lambda x: x is not null) as issues
from c, o, p, r""",
    "joi22_employer_matches": """
with s as (select split_part(p_name, ' ', 1) as e, list_concat(list(distinct split_part(p_name, ' ', 2)), ['economy', 'small']) as terms from part where p_size % 2 = 0 group by 1)
select p_partkey, e as employer, 'prefix' as kind from part join s on split_part(p_name, ' ', 1) = e and list_contains(terms, split_part(p_name, ' ', 2)) and list_contains(terms, lower(p_type))
union all select p_partkey, p_name || ' ' || lower(p_type) || ' group', 'equal' from part""",
}
