"""Queries over identities and their gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from .tables import table

BLOCKED = ("2", "3")


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.element_at(F.split("p_name", " "), 1).alias("w"))


def agg12_identity_matrix(spark: SparkSession, d: str) -> DataFrame:
    url = lambda s: F.concat(F.lit("HTTPS://"), "w", F.lit(s))
    found = I.public_identity(url(".com:443/"), F.when(F.col("p_partkey") % 2 == 0, url(".com/careers?utm_source=x")), F.concat(F.lit("https://jobs.lever.co/"), "w", F.lit("/x/")), F.lit("not a url"), F.lit("lever"))
    return _part(spark, d).select("p_partkey", found.alias("i")).select("p_partkey", "i.website_url", "i.career_page_url", "i.job_board.provider", "i.job_board.tenant", F.col("i.job_board.canonical_url").alias("board"), F.col("i.opening.canonical_url").alias("opening"))


def fn18_posting_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    head = F.when(k == 0, " https://linkedin.com:443").when(k == 1, "HTTPS://WWW.LinkedIn.com").when(k == 2, "http://www.linkedin.com").when(k == 3, "https://de.linkedin.com").otherwise("https://me@linkedin.com")
    return _part(spark, d).select("p_partkey", I.canonical_posting_url(F.concat(head, F.lit("/jobs/view/x-"), "p_partkey", F.lit("/?a=1#b"))).alias("url"))


def fn34_title_places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return _part(spark, d).select("p_partkey", I.title_location(F.concat("p_name", F.when(k == 0, " (NYC)").when(k == 1, " - Washington DC").when(k == 2, ", New York City").otherwise(" in nyc"))).alias("place"))


def fn38_career_keywords(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    url = F.concat(F.lit("https://"), "w", F.when(k == 0, ".com/Careers").when(k == 1, ".com/jobsite-x/jobs-to-be-done").when(k == 2, ".jobs/x").otherwise(".com/join-us/now"))
    return _part(spark, d).select("p_partkey", I.career_keyword(url, F.col("p_name"), "career").alias("career"), I.career_keyword(url, F.col("p_name"), "jobs").alias("jobs"), I.career_keyword(url, F.concat("p_name", F.lit(" Open Roles")), "join-us").alias("join"), I.career_keyword(url, F.concat("p_name", F.lit(" Open Roles")), "open roles").alias("open"))


def fn40_company_queries(spark: SparkSession, d: str) -> DataFrame:
    domain = F.when(F.col("p_partkey") % 2 == 0, F.concat("w", F.lit(".com")))
    name = F.concat(F.lit("The "), "p_name", F.lit(" Co., Inc"))
    return _part(spark, d).select(
        "p_partkey", F.array_join(I.search_queries(F.col("p_name"), domain), "|").alias("queries"), F.array_join(I.identity_tokens(name, domain), ",").alias("tokens"), I.company_words(name).alias("words"), I.strict_entity_key(name).alias("key"),
    )


def fn82_sitemap_order(spark: SparkSession, d: str) -> DataFrame:
    found = I.sitemap_priority(F.regexp_replace("url", "/en/", "/en-US/jobs/"), "US")
    return table(spark, d, "pages").select("page_id", found["region_rank"].alias("region_rank"), found["inventory_rank"].alias("inventory_rank"))


def joi16_boards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    target = {"provider": F.lit("lever"), "tenant": F.col("w"), "url": F.concat(F.lit("https://jobs.lever.co/"), "w")}
    found = I.board_matches(F.when(k == 0, "other").otherwise("lever"), F.when(k == 1, "x").otherwise(F.col("w")), F.concat(F.lit("https://JOBS.lever.co/"), "w", F.when(k == 2, "/").otherwise("?q=1")), target)
    return _part(spark, d).select("p_partkey", found.alias("matches"))


def agg28_durable_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    outcome = I.durable_outcome(F.when(F.col("o_orderstatus") == "F", "u"), F.col("o_totalprice") < 50000, first.isin(*BLOCKED), F.col("o_orderstatus") == "O")
    return o.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def cmp09_outcomes_match(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    expected = F.when(F.col("l_linenumber") == 1, F.lit("F"))
    found = I.outcomes_match({"status": (F.lit("N"), F.col("l_returnflag"))}, {"semantic": (expected, F.col("l_linestatus"))})
    return l.groupBy(found.alias("matches")).agg(F.count("*").alias("n"))


def cmp11_route_failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    route = {"present": k % 7 != 0, "verified": k % 2 == 0, "provider": F.lit("p"), "source_tenant": F.when(k % 3 == 0, "x").otherwise("s"), "source_board": F.lit("b"), "target_tenant": F.lit("t"), "target_board": F.when(k % 5 != 0, "c"), "url": F.lit("u")}
    opening = {"provider": F.lit("p"), "tenant": F.lit("t"), "board": F.lit("c"), "url": F.when(k % 11 == 0, "v").otherwise("u")}
    codes = I.route_failures(route, {"provider": F.lit("p"), "tenant": F.lit("s"), "board": F.lit("b")}, opening)
    twice = I.combined_failures(codes, F.array(F.lit("OPENING_ROUTE_URL_MISMATCH")), codes)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(codes, ",").alias("codes"), F.size(twice).alias("n_combined"))


def ext23_direct_candidates(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.when(F.col("p_partkey") % 3 == 0, "https://jobs.lever.co/").when(F.col("p_partkey") % 3 == 1, "https://a.com/").otherwise("not a url "), "w")
    apply, site = I.direct_candidate(url, "external_apply", False), I.direct_candidate(url, "first_party_ats_link", True)
    return _part(spark, d).select("p_partkey", apply["url"].alias("apply_url"), apply["provider"].alias("provider"), site["kind"].alias("site_kind"))


QUERIES = {
    f.__name__: f
    for f in (
        agg12_identity_matrix, fn18_posting_urls, fn34_title_places, fn38_career_keywords, fn40_company_queries, fn82_sitemap_order, joi16_boards, agg28_durable_outcomes, cmp09_outcomes_match,
        cmp11_route_failures, ext23_direct_candidates,
    )
}

_P = "p as (select p_partkey, p_name, p_type, split_part(p_name, ' ', 1) as w, split_part(p_name, ' ', 2) as w2 from part)"
_CODES = """
c as (select o_orderkey, case when o_orderkey % 7 = 0 then '' else concat_ws(',', case when o_orderkey % 2 <> 0 then 'OPENING_ROUTE_EVIDENCE_UNVERIFIED' end, case when o_orderkey % 3 = 0 then 'OPENING_ROUTE_SOURCE_MISMATCH' end,
  case when o_orderkey % 5 = 0 then 'OPENING_ROUTE_TARGET_MISMATCH' end, case when o_orderkey % 11 = 0 then 'OPENING_ROUTE_URL_MISMATCH' end) end as codes from orders)"""
ORACLES = {
    "agg12_identity_matrix": f"""
with {_P} select p_partkey, 'https://' || w || '.com' as website_url, case when p_partkey % 2 = 0 then 'https://' || w || '.com/careers' end as career_page_url, 'lever' as provider, 'https://jobs.lever.co/' || w as tenant,
  'https://jobs.lever.co/' || w || '/x' as board, cast(null as varchar) as opening from p""",
    "fn18_posting_urls": "select p_partkey, case when p_partkey % 5 in (0, 1) then 'https://www.linkedin.com/jobs/view/x-' || p_partkey end as url from part",
    "fn34_title_places": "select p_partkey, case p_partkey % 4 when 0 then 'New York, NY' when 1 then 'Washington, DC' when 2 then 'New York, NY' end as place from part",
    "fn38_career_keywords": "select p_partkey, p_partkey % 4 = 0 as career, p_partkey % 4 = 2 as jobs, p_partkey % 4 = 3 as join, true as open from part",
    "fn40_company_queries": f"""
with {_P} select p_partkey, p_name || ' careers jobs|' || case when p_partkey % 2 = 0 then 'site:' || w || '.com careers|site:' || w || '.com jobs|' else '' end || p_name || ' careers|' || p_name || ' jobs' as queries,
  array_to_string(list_filter([w, w2], lambda x: length(x) >= 3), ',') as tokens, 'the ' || p_name || ' co inc' as words, w || w2 as key from p""",
    "fn82_sitemap_order": "select page_id, case when url like '%/en/%' then 0 else 1 end as region_rank, case when url like '%/en/%' then 0 else 1 end as inventory_rank from pages",
    "joi16_boards": "select p_partkey, p_partkey % 4 = 2 as matches from part",
    "agg28_durable_outcomes": """
select case when o_orderstatus = 'F' then 'exact' when o_totalprice < 50000 then 'verified_no_match' when substr(o_orderpriority, 1, 1) in ('2', '3') and o_orderstatus = 'O' then 'external_blocked' else 'unresolved' end as outcome,
  count(*) as n from orders group by 1""",
    "cmp09_outcomes_match": "select l_returnflag = 'N' and (l_linenumber <> 1 or l_linestatus = 'F') as matches, count(*) as n from lineitem group by 1",
    "cmp11_route_failures": f"""
with {_CODES} select o_orderkey, codes, cast(case when codes = '' then 0 else len(string_split(codes, ',')) end + case when contains(codes, 'URL') then 0 else 1 end as integer) as n_combined from c""",
    "ext23_direct_candidates": f"""
with {_P} select p_partkey, case p_partkey % 3 when 0 then 'https://jobs.lever.co/' || w when 1 then 'https://a.com/' || w end as apply_url, case when p_partkey % 3 = 0 then 'lever' end as provider,
  case when p_partkey % 3 = 0 then 'first_party_ats_link' end as site_kind from p""",
}
