"""Queries that apply the stores to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stores as K
from .tables import table

NOW = "2024-01-20"
DAY = 86_400


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return events.filter(F.col("event_type").isin(*kinds)) if kinds else events


def js01_scanned_records(spark: SparkSession, d: str) -> DataFrame:
    return K.first_cards(_events(spark, d).select("user_id", "event_id"), "user_id", "event_id", 30)


def js02_visible_cards(spark: SparkSession, d: str) -> DataFrame:
    return K.first_cards(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "page_id"), "host", "page_id")


def js03_indexed_cards(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("job_id"))
    return K.indexed_cards(lines, "l_orderkey", "ord", "job_id", 2)


def js05_pending_captures(spark: SparkSession, d: str) -> DataFrame:
    return K.fresh(_events(spark, d).select("event_id", "ts"), "ts", _now(), DAY).select("event_id")


def js08_upsert_captures(spark: SparkSession, d: str) -> DataFrame:
    store, more = (_events(spark, d, k).select("user_id", "event_id", "event_type") for k in ("view", "click"))
    return K.upsert_newest(store, more, "user_id", "event_id", 30)


def js09_captured_urls(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "documents").select("doc_id", "source")
    captured = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "captured").alias("source"))
    return K.with_captured(records, captured, "doc_id", "source")


def js10_stored_results(spark: SparkSession, d: str) -> DataFrame:
    store = _events(spark, d).select("event_id", "ts", F.when(F.col("event_type") == "view", 1).otherwise(2).alias("schema_version"))
    return K.stored_results(store, 2, "ts", "event_id", _now(), 6 * 3600, 30).select("event_id")


def js11_current_results(spark: SparkSession, d: str) -> DataFrame:
    orders = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("result"))
    return K.current_results(table(spark, d, "customer").filter("c_acctbal > 0"), [orders("F"), orders("O"), orders("P")], "c_custkey")


def js12_merged_results(spark: SparkSession, d: str) -> DataFrame:
    store = _events(spark, d, "purchase").select("user_id", F.col("event_id").alias("saved_at"), "value")
    return K.upsert_newest(store, _events(spark, d, "signup", "error").select("user_id", F.col("event_id").alias("saved_at"), "value"), "user_id", "saved_at")


def js13_export_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").alias("id"), "lang", F.when(F.col("n_chars") > 1000, F.col("source")).otherwise("").alias("source"), F.col("quality").alias("result_quality"), F.col("quality").isNotNull().alias("has_result"),
        F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "odd").alias("pipeline"),
    )
    return K.export_rows(rows, {"id": ("id",), "name": ("lang", "result_quality"), "external": ("source",), "quality": ("result_quality",)}, "pipeline", "external")


def js14_result_lookup(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_custkey") * 7 % 1000).alias("url"))
    results = table(spark, d, "customer").filter("c_acctbal > 3000").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("url"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("found"))
    return K.result_for(records, results, "c_custkey", "url", ["c_nationkey", "c_mktsegment"], "ord", "found")


def src19_layered_evidence(spark: SparkSession, d: str) -> DataFrame:
    layers = _events(spark, d, "view", "click", "purchase").select("user_id", "event_type", "event_id", "ts")
    return K.load_evidence(layers, "user_id", "event_type", "ts", _now(), 5 * DAY, ["view", "click", "purchase"]).select("user_id", "event_type", "event_id")


def src20_cached_evidence(spark: SparkSession, d: str) -> DataFrame:
    return K.fresh(_events(spark, d, "signup"), "ts", _now(), 7 * DAY).groupBy("user_id").agg(F.count("*").alias("n"))


def src21_completed_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return K.looked_up(table(spark, d, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"], "o_orderkey")


def src22_stage_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("stage"), (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey")).alias("ord"))
    wanted = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("stage"))
    return K.looked_up(wanted, lines, ["o_orderkey", "stage"], "ord")


def snk05_upsert_completion(spark: SparkSession, d: str) -> DataFrame:
    store, more = (table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey", "o_orderstatus") for s in ("O", "F"))
    return K.upsert_newest(store, more, "o_custkey", "o_orderkey")


def snk06_invalidated_from(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return K.invalidated_from(lines, table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


def snk10_merged_parents(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)[0]


def snk10_merged_boards(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)[1]


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    last = lambda k: _events(spark, d, k).groupBy("user_id").agg(F.max("event_id").alias("at"), (F.max("event_id") % 2).alias("url"))
    boards = _events(spark, d, "click").select("user_id", F.col("event_id").alias("at"))
    return K.merge_evidence(last("view"), last("signup"), "user_id", "at", "url", boards, 3)


def snk11_invalidated_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = _events(spark, d, "view", "click", "purchase").select("user_id", "event_type", "event_id")
    gone = _events(spark, d).filter("value > 180 and event_type in ('click', 'purchase')").select("user_id", "event_type")
    return K.invalidate_layer(layers, gone, "user_id", "event_type", ["view", "click", "purchase"])


def snk14_export_cells(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit(" =SUM("), "value", F.lit(")"))).when(F.col("user_id") % 4 == 1, (-F.col("value")).cast("string")).when(F.col("user_id") % 4 == 2, F.col("event_type"))
    return _events(spark, d).select("event_id", K.csv_cell(value).alias("cell"))


def snk15_replay_export(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("company_name"), F.when(F.col("n_chars") > 800, F.col("source")).alias("company_website_url"), F.lit(None).cast("string").alias("external_apply_url"), "source")
    kept = K.matching(docs, {"company_name": ["en", "de"], "source": []})
    sound = K.has_source(F.col("company_name"), F.col("company_website_url"), F.col("external_apply_url"), F.col("source"), False)
    return kept.filter(sound).select("doc_id", "company_name", "company_website_url")


def str10_pending(spark: SparkSession, d: str) -> DataFrame:
    return K.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


def fil01_matching(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("codes"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(codes, "o_orderkey")
    return K.matching(rows, {"o_orderstatus": ["F", "P"], "o_orderpriority": []}, {"codes": ["R", "A"]}).select("o_orderkey")


def fil02_required_source(spark: SparkSession, d: str) -> DataFrame:
    flag = K.has_source(F.col("lang"), F.when(F.col("n_chars") > 1000, F.col("source")), F.when(F.col("doc_id") % 3 == 0, " "), F.col("source"), True)
    return table(spark, d, "documents").select("doc_id", flag.alias("kept"))


def fil04_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return K.candidates(docs, ["lang", "text"], ["toxic"], ["doc_id", "lang", "n_chars", "absent"])


def fil18_native_posting(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", " Active ").otherwise("closed")
    mode = F.when(F.col("o_orderpriority") < "4", "linkedin_native").otherwise("external")
    url = F.col("o_custkey").cast("string")
    found = K.native_posting(state, mode, F.substring("o_orderpriority", 1, 1), "2", url, F.when(F.col("o_orderkey") % 2 == 0, url))
    return o.select("o_orderkey", found.alias("url"))


def fil19_closed_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Closed ").when(F.col("o_orderstatus") == "P", "open")
    return table(spark, d, "orders").select("o_orderkey", K.closed_status(status, F.when(F.col("o_totalprice") > 200000, "EXPIRED")).alias("status"))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records of three stages."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    first = F.substring("o_orderpriority", 1, 1).cast("int")
    status = lambda k: F.when(first > k, "success").when(first == k, F.when(F.col("o_totalprice") > 250000, "not_run").otherwise("failed")).otherwise("not_run")
    retry = F.when(F.col("o_totalprice") < 50000, None).otherwise(F.col("o_totalprice") < 120000)
    stages = F.array(*[F.struct(F.lit(f"s{k}").alias("stage"), status(k).alias("status"), retry.alias("retryable"), F.col("o_orderpriority").alias("reason_code")) for k in (1, 2, 3)])
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("pipeline_status"), F.when(F.col("o_orderkey") % 11 == 0, F.slice(stages, 1, 2)).otherwise(stages).alias("stages"))


def fil21_resume_decision(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d).select("o_orderkey", K.resume_decision(F.col("pipeline_status"), F.col("stages"), ("s1", "s2", "s3")).alias("r")).select("o_orderkey", "r.*")


def snk01_result_records(spark: SparkSession, d: str) -> DataFrame:
    return K.result_records(_staged(spark, d), "stages", {"s1": "first_status", "s3": "last_status"}).drop("stages")


def snk03_as_json(spark: SparkSession, d: str) -> DataFrame:
    return K.as_json(table(spark, d, "labels").select("doc_id", F.nullif("toxic", F.lit(0)).alias("toxic")))


QUERIES = {
    f.__name__: f
    for f in (
        js01_scanned_records, js02_visible_cards, js03_indexed_cards, js05_pending_captures, js08_upsert_captures, js09_captured_urls, js10_stored_results, js11_current_results,
        js12_merged_results, js13_export_rows, js14_result_lookup, src19_layered_evidence, src20_cached_evidence, src21_completed_lookup, src22_stage_lookup, snk01_result_records,
        snk03_as_json, snk05_upsert_completion, snk06_invalidated_from, snk10_merged_parents, snk10_merged_boards, snk11_invalidated_layers, snk14_export_cells, snk15_replay_export,
        str10_pending, fil01_matching, fil02_required_source, fil04_candidates, fil18_native_posting, fil19_closed_status, fil21_resume_decision,
    )
}

_STAGED = """
s as (select o_orderkey, case when o_orderstatus = 'F' then 'success' else 'failed' end as pipeline_status, cast(substr(o_orderpriority, 1, 1) as integer) as p, o_totalprice, o_orderpriority,
  case when o_totalprice < 50000 then null else o_totalprice < 120000 end as retryable, o_orderkey % 11 = 0 as short from orders),
t as (select *, case when p > 1 then 'success' when p = 1 and o_totalprice <= 250000 then 'failed' else 'not_run' end as s1,
  case when p > 2 then 'success' when p = 2 and o_totalprice <= 250000 then 'failed' else 'not_run' end as s2,
  case when p > 3 then 'success' when p = 3 and o_totalprice <= 250000 then 'failed' else 'not_run' end as s3 from s)"""
_LAST = """(select user_id, max(event_id) as "at", max(event_id) % 2 as url from events where event_type = '{}' group by 1)"""
_PARENTS = f"""
b as (select coalesce(p.user_id, n.user_id) as user_id, p."at" as pa, p.url as pp, n."at" as na, n.url as np, n."at" is not null and (p."at" is null or n."at" >= p."at") as taken
  from {_LAST.format("view")} p full join {_LAST.format("signup")} n on p.user_id = n.user_id),
q as (select user_id, case when taken then na else pa end as "at", case when taken then np else pp end as url, taken and pp is not null and pp <> np as changed from b)"""

ORACLES = {
    "js01_scanned_records": "select user_id, min(event_id) as event_id from events group by 1 order by 2 limit 30",
    "js02_visible_cards": "select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, min(page_id) as page_id from pages where url is not null group by 1",
    "js03_indexed_cards": """
select l_orderkey, cast(l_linenumber as bigint) * 1000000000 + l_partkey as ord, l_partkey as job_id from lineitem where l_quantity > 10 and l_partkey is not null
  qualify row_number() over (partition by l_orderkey order by ord) <= 2""",
    "js05_pending_captures": f"select event_id from events where ts <= timestamp '{NOW}' and ts >= timestamp '{NOW}' - interval 1 day",
    "js08_upsert_captures": """
select user_id, event_id, event_type from (select * from events where event_type in ('view', 'click') qualify row_number() over (partition by user_id order by event_id desc) = 1)
  order by event_id desc, user_id limit 30""",
    "js09_captured_urls": "select d.doc_id, case when quality = 1 then 'captured' else source end as source from documents d left join labels l on d.doc_id = l.doc_id",
    "js10_stored_results": f"select event_id from events where event_type <> 'view' and ts <= timestamp '{NOW}' and ts >= timestamp '{NOW}' - interval 6 hour order by ts desc, event_id limit 30",
    "js11_current_results": """
with r as (select o_custkey as c_custkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as source, min(o_orderkey) as result from orders where o_orderstatus in ('F', 'O', 'P') group by 1, 2)
select c_custkey, source, result from r where c_custkey in (select c_custkey from customer where c_acctbal > 0) qualify row_number() over (partition by c_custkey order by source) = 1""",
    "js12_merged_results": """
select user_id, event_id as saved_at, value from events where event_type in ('purchase', 'signup', 'error') qualify row_number() over (partition by user_id order by event_id desc) = 1""",
    "js13_export_rows": """
with r as (select d.doc_id, lang, case when n_chars > 1000 then source else '' end as source, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)
select cast(doc_id as varchar) as id, coalesce(nullif(lang, ''), cast(quality as varchar), '') as name, coalesce(source, '') as external, coalesce(cast(quality as varchar), '') as quality,
  case when toxic = 1 then 'failed' when coalesce(source, '') <> '' then 'external_apply_captured' when quality is not null then 'verification_failed' else 'not_verified' end as result_status from r""",
    "js14_result_lookup": """
with s as (select * from customer where c_acctbal > 3000), g as (select c_nationkey, c_mktsegment, min_by(c_name, c_custkey) as n from s group by 1, 2)
select c.c_custkey, coalesce(s.c_name, g.n) as found from customer c left join s on c.c_custkey * 7 % 1000 = s.c_custkey left join g on c.c_nationkey = g.c_nationkey and c.c_mktsegment = g.c_mktsegment""",
    "src19_layered_evidence": f"""
with l as (select user_id, event_type, event_id from events where event_type in ('view', 'click', 'purchase') and ts <= timestamp '{NOW}' and ts >= timestamp '{NOW}' - interval 5 day)
select user_id, event_type, event_id from l where user_id in (select user_id from l where event_type = 'view')
  and (event_type <> 'purchase' or user_id in (select user_id from l where event_type = 'click'))""",
    "src20_cached_evidence": f"select user_id, count(*) as n from events where event_type = 'signup' and ts <= timestamp '{NOW}' and ts >= timestamp '{NOW}' - interval 7 day group by 1",
    "src21_completed_lookup": """
select c_custkey, c_name, o_orderkey, o_orderstatus from customer join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1) on c_custkey = o_custkey""",
    "src22_stage_lookup": """
with l as (select l_orderkey, l_returnflag, max(cast(l_linenumber as bigint) * 1000000000 + l_partkey) as ord from lineitem group by 1, 2)
select o_orderkey, l_returnflag as stage, ord from orders join l on o_orderkey = l_orderkey and l_returnflag = case when o_orderstatus = 'F' then 'R' else 'N' end""",
    "snk01_result_records": f"with {_STAGED} select o_orderkey, pipeline_status, s1 as first_status, case when short then 'not_run' else s3 end as last_status from t",
    "snk03_as_json": """select '{"doc_id":' || doc_id || case when toxic <> 0 then ',"toxic":' || toxic else '' end || '}' as record from labels""",
    "snk05_upsert_completion": "select o_custkey, o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'F') qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1",
    "snk06_invalidated_from": """
with c as (select l_orderkey, min(l_linenumber) as n from lineitem where l_returnflag = 'R' group by 1)
select l.l_orderkey, l_linenumber from lineitem l left join c on l.l_orderkey = c.l_orderkey where n is null or l_linenumber < n""",
    "snk10_merged_parents": f'with {_PARENTS} select user_id, "at", url, changed from q',
    "snk10_merged_boards": f"""
with {_PARENTS} select user_id, event_id as "at" from events where event_type = 'click' and user_id not in (select user_id from q where changed)
  qualify row_number() over (partition by user_id order by event_id desc) <= 3""",
    "snk11_invalidated_layers": """
with r as (select user_id, event_type, event_id, case event_type when 'view' then 1 when 'click' then 2 else 3 end as k from events where event_type in ('view', 'click', 'purchase')),
c as (select user_id, min(case event_type when 'click' then 2 else 3 end) as n from events where value > 180 and event_type in ('click', 'purchase') group by 1)
select r.user_id, event_type, event_id from r left join c on r.user_id = c.user_id where n is null or k < n""",
    "snk14_export_cells": """
select event_id, case user_id % 4 when 0 then ''' =SUM(' || value || ')' when 1 then case when value > 0 then '''-' || value when value = 0 then '''-0.0' else cast(-value as varchar) end
  when 2 then event_type else '' end as cell from events""",
    "snk15_replay_export": "select doc_id, lang as company_name, source as company_website_url from documents where lang in ('en', 'de') and n_chars > 800 and trim(source) <> ''",
    "str10_pending": "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)",
    "fil01_matching": "select distinct o_orderkey from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus in ('F', 'P') and l_returnflag in ('R', 'A')",
    "fil02_required_source": "select doc_id, coalesce(trim(lang) <> '', false) and coalesce(trim(source) <> '', false) as kept from documents",
    "fil04_candidates": "select d.doc_id, lang, n_chars from documents d left join labels l on d.doc_id = l.doc_id where trim(lang) <> '' and trim(text) <> '' and toxic is null",
    "fil18_native_posting": "select o_orderkey, case when o_orderstatus = 'O' and o_orderpriority like '2%' then cast(o_custkey as varchar) end as url from orders",
    "fil19_closed_status": "select o_orderkey, case when o_orderstatus = 'F' then 'closed' when o_totalprice > 200000 then 'expired' end as status from orders",
    "fil21_resume_decision": f"""
with {_STAGED},
u as (select *, case when s1 <> 'success' then 's1' when s2 <> 'success' then 's2' when s3 <> 'success' then 's3' end as f, case when s1 <> 'success' then s1 when s2 <> 'success' then s2 when s3 <> 'success' then s3 end as fs from t),
v as (select *, case when pipeline_status = 'success' then 'pipeline_success' when short then 'invalid_stage_chain' when f is null then 'inconsistent_pipeline_status' when fs = 'not_run' then 'missing_failure_stage'
  when retryable is null then 'missing_retryability' when retryable then 'retryable_stage_failure' else 'non_retryable_stage_outcome' end as reason from u)
select o_orderkey, reason, case reason when 'pipeline_success' then 'completion_restore' when 'retryable_stage_failure' then 'retryable_resubmit' when 'non_retryable_stage_outcome' then 'non_retryable_restore' else 'unclassified_restore' end as action,
  case when reason in ('retryable_stage_failure', 'non_retryable_stage_outcome') then f end as retry_stage, case when reason in ('retryable_stage_failure', 'non_retryable_stage_outcome') then o_orderpriority end as reason_code from v""",
}
