"""Queries that apply the summary operators to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summaries as S
from .tables import table

STATUSES = ("O", "F", "P")


def agg01_master_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.master_summary(spark, table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderstatus")


def agg02_presence_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    flags = docs.select(F.when(F.col("quality").isNotNull(), "y").alias("labelled"), F.when(F.col("toxic") == 1, "y").alias("toxic"), F.when(F.col("n_chars") > 2000, "y").alias("long_text"))
    return S.presence_rates(flags, ["labelled", "toxic", "long_text"])


def agg03_stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    return S.stage_funnel(orders, lines, "o_orderkey", "l_returnflag", "l_linestatus", ("A", "N", "R"))


def agg04_provider_stage_status(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", (F.floor(F.col("value") / 50) * 50).cast("long").alias("bucket"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.counts_by(events.join(customers, "user_id"), "c_mktsegment", "event_type", "bucket")


def agg05_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.reason_counts(table(spark, d, "orders"), "o_orderpriority")


def agg06_provider_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.reason_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


def agg07_failure_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("stage"), F.lit(0).alias("ord"), F.col("l_linestatus").alias("provider"),
        F.when(F.col("l_discount") >= 0.05, "HIGH_DISCOUNT").otherwise("LOW_DISCOUNT").alias("reason_code"), (F.col("l_quantity") > 45).alias("retryable"),
        F.lit("failed").alias("status"), F.col("l_linenumber").alias("outcome_rank"), "l_suppkey",
    )
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("company"))
    found = S.failure_groups(lines.join(suppliers, "l_suppkey"))
    return found.select("stage", "provider", "reason_code", "company_count", "retryable_count", "best_outcome", F.array_join("names", "|").alias("names"))


def agg08_event_counts(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("role", (F.length("text") > 100).alias("long"))
    return turns.groupBy("role", "long").agg(F.count("*").alias("n"))


def agg09_first_evidence(spark: SparkSession, d: str) -> DataFrame:
    purchases = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))
    first = purchases.groupBy("user_id").agg(F.min(F.struct("event_id", "k")).alias("e")).select("e.k")
    return first.filter(S.present("k")).groupBy("k").agg(F.count("*").alias("n"))


def agg11_stage_matrix(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("click", "error", "purchase", "signup", "view")
    events = table(spark, d, "events").select("user_id", "event_type")
    found = S.stage_matrix(events, "user_id", "event_type", F.count(F.lit(1)), kinds)
    return found.select("user_id", *[F.coalesce(F.col(k), F.lit(0)).alias(f"n_{k}") for k in kinds])


def agg13_duration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("quantity"), "l_linestatus")
    return S.durations(lines, ["l_returnflag"], "quantity", {"p50": 0.5, "p95": 0.95}, F.col("l_linestatus") == "X")


def agg15_metric_gated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1500).alias("has_opening")).join(table(spark, d, "labels"), "doc_id", "left")
    records = docs.select(
        "has_opening", F.col("quality").isNotNull().alias("annotated"), F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").alias("verdict"),
        F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "false").alias("eligible"), (F.col("toxic") == 1).alias("defect"),
    )
    return S.annotation_metrics(records, {"all": F.lit(True), "labelled": F.col("annotated")})


def agg18_terminal_outcome(spark: SparkSession, d: str) -> DataFrame:
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    outcome = S.cascade([(status == "F", "exact_opening"), (priority.startswith("1"), "retryable_failure"), (priority.startswith("2") & (price > 100000), "external_blocked"), (price < 20000, "source_closed")], "other_non_success")
    rows = table(spark, d, "orders").select(outcome.alias("outcome"), S.outcome_rank(outcome).alias("outcome_rank"))
    return S.counts_by(rows, "outcome", "outcome_rank")


def agg20_first_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 500, "y").alias("long_text")).join(table(spark, d, "labels"), "doc_id", "left")
    return S.counts_by(docs.select(F.coalesce(S.first_missing({"lang": "lang", "long_text": "long_text", "quality": "quality"}), F.lit("none")).alias("missing")), "missing")


def agg21_first_present(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    label = S.first_present(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good"), "lang")
    return S.counts_by(docs.select(label.alias("label")), "label")


def agg24_route_venn(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, d, "events").select("user_id", S.route_mask({"click": kind == "click", "purchase": (kind == "purchase") & (F.col("value") > 90), "view": (kind == "view") & (F.col("value") > 95)}).alias("mask"))
    return S.route_overlap(events, "user_id", "mask", 3)


def agg24_route_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 10).alias("input"), (F.col("l_discount") > 0.02).alias("candidate"), (F.col("l_tax") > 0.03).alias("board"))
    return S.route_funnel(rows, "l_returnflag", ["input", "candidate", "board"])


def agg25_ledger_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", (F.floor(F.col("value") / 25)).cast("long").alias("band"), "user_id")
    return S.signature_clusters(rows, ["event_type", "band"], "user_id", 100)


def agg29_count_map(spark: SparkSession, d: str) -> DataFrame:
    found = S.count_map(table(spark, d, "events"), "event_type")
    return found.select(F.explode("counts").alias("event_type", "n"))


def agg30_blockers(spark: SparkSession, d: str) -> DataFrame:
    found = S.blockers(table(spark, d, "orders"), {"rows": (F.count("*"), 1), "open": (F.count_if(F.col("o_orderstatus") == "O"), 10**9), "price": (F.max("o_totalprice"), 10**9)})
    return found.select(F.array_join("blockers", "|").alias("blockers"))


def agg32_worst_reason(spark: SparkSession, d: str) -> DataFrame:
    code = S.cascade([(F.col("event_type") == "click", "NETWORK_TIMEOUT"), (F.col("event_type") == "purchase", "HTTP_FORBIDDEN"), (F.col("value") > 90, "CAPTCHA_REQUIRED")], "FETCH_FAILED")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(code).alias("reasons"))
    return S.counts_by(rows.select(S.worst_reason(F.col("reasons")).alias("reason")), "reason")


def agg33_merged_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", (F.col("value") > 50).alias("high"), "event_id", (F.col("user_id") % 7).cast("string").alias("source"))
    return S.merged_errors(rows, ["event_type", "high"], "event_id", "source").withColumn("provenance", F.array_join("provenance", "|"))


def agg34_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return S.by_priority(table(spark, d, "events"), ["user_id"], "event_type", ["purchase", "click"])


def agg36_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").agg(F.countDistinct("url").alias("urls"), F.countDistinct(F.substring_index(F.substring_index("url", "/", 3), "/", -1)).alias("hosts"), F.count("*").alias("n"))


def agg37_accuracy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 300, F.when(F.col("n_chars") > 1500, "1").otherwise("0")).alias("guess"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("truth")), "doc_id")
    return S.accuracy(rows, "truth", "guess")


_ANNOTATION = """
select '{scope}' as scope, 'precision' as metric, case when u = 0 then 'available' else 'not_reportable' end as status, pn as numerator, pd as denominator, u as unknown_count,
  case when u = 0 and pd > 0 then pn / pd end as value from (select count(*) filter (has_opening and quality = 1) as pn, count(*) filter (has_opening and quality is not null) as pd, count(*) filter (quality is null) as u from {rows})
union all
select '{scope}', 'recall', case when u = 0 and rd > 0 then 'available' else 'not_reportable' end, rn, rd, u, case when u = 0 and rd > 0 then rn / rd end
  from (select count(*) filter (has_opening and quality = 1) as rn, count(*) filter (quality = 1) as rd, count(*) filter (quality is null) as u from {rows})
union all
select '{scope}', 'defect_rate', case when u = 0 then 'available' else 'not_reportable' end, n, t, u, case when u = 0 and t > 0 then n / t end
  from (select count(*) filter (toxic = 1) as n, count(*) as t, count(*) filter (quality is null) as u from {rows})"""

ORACLES = {
    "agg01_master_summary": """
select 'records' as section, 'total' as name, count(*) as n from orders
union all select 'present', 'o_orderpriority', count(*) filter (trim(o_orderpriority) <> '') from orders
union all select 'present', 'o_orderstatus', count(*) filter (trim(o_orderstatus) <> '') from orders
union all select 'status', coalesce(o_orderstatus, 'not_recorded'), count(*) from orders group by o_orderstatus""",
    "agg02_presence_rates": """
with d as (select quality is not null as l, coalesce(toxic = 1, false) as t, coalesce(n_chars > 2000, false) as g from documents left join labels using (doc_id)),
c as (select count(*) as n, count(*) filter (l) as l, count(*) filter (t) as t, count(*) filter (g) as g from d)
select 'labelled' as metric, l as n_present, n as denominator, l / n as rate from c union all select 'toxic', t, n, t / n from c union all select 'long_text', g, n, g / n from c""",
    "agg03_stage_funnel": """
with s as (select * from (values ('A', 0), ('N', 1), ('R', 2)) t(stage, ord)),
e as (select l_orderkey as k, l_returnflag as stage, min(l_linestatus) as status from lineitem group by 1, 2)
select s.stage, s.ord, coalesce(e.status, 'not_recorded') as status, count(*) as n from orders cross join s left join e on e.k = o_orderkey and e.stage = s.stage group by 1, 2, 3""",
    "agg04_provider_stage_status": """
select c_mktsegment, event_type, cast(floor(value / 50) * 50 as bigint) as bucket, count(*) as n from events join customer on c_custkey = user_id group by 1, 2, 3""",
    "agg05_reason_counts": "select o_orderpriority, count(*) as n from orders where trim(o_orderpriority) <> '' group by 1",
    "agg06_provider_reason_counts": "select o_orderstatus, o_orderpriority, count(*) as n from orders where trim(o_orderpriority) <> '' group by 1, 2",
    "agg07_failure_groups": """
with r as (select l_returnflag as stage, l_linestatus as provider, case when l_discount >= 0.05 then 'HIGH_DISCOUNT' else 'LOW_DISCOUNT' end as reason_code, s_name as company,
  bool_or(l_quantity > 45) as retryable, min(l_linenumber) as o from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3, 4),
n as (select *, row_number() over (partition by stage, provider, reason_code order by lower(company), company) as i from r)
select stage, provider, reason_code, count(*) as company_count, count(*) filter (retryable) as retryable_count, min(o) as best_outcome,
  string_agg(company, '|' order by i) filter (i <= 20) as names from n group by 1, 2, 3""",
    "agg08_event_counts": "select role, length(text) > 100 as long, count(*) as n from conversations group by 1, 2",
    "agg09_first_evidence": """
with f as (select user_id, arg_min(json_extract_string(props, '$.k'), event_id) as k from events where event_type = 'purchase' group by 1)
select k, count(*) as n from f where trim(k) <> '' group by 1""",
    "agg11_stage_matrix": "select user_id, "
    + ", ".join(f"count(*) filter (event_type = '{k}') as n_{k}" for k in ("click", "error", "purchase", "signup", "view"))
    + " from events group by 1",
    "agg13_duration_percentiles": """
select l_returnflag, count(*) as n, quantile_disc(cast(l_quantity as bigint), 0.5) as p50, quantile_disc(cast(l_quantity as bigint), 0.95) as p95 from lineitem where l_linestatus <> 'X' group by 1""",
    "agg15_metric_gated": "with a as (select n_chars > 1500 as has_opening, quality, toxic from documents left join labels using (doc_id)), b as (select * from a where quality is not null) "
    + _ANNOTATION.format(scope="all", rows="a") + " union all " + _ANNOTATION.format(scope="labelled", rows="b"),
    "agg18_terminal_outcome": """
with o as (select case when o_orderstatus = 'F' then 'exact_opening' when starts_with(o_orderpriority, '1') then 'retryable_failure' when starts_with(o_orderpriority, '2') and o_totalprice > 100000 then 'external_blocked'
  when o_totalprice < 20000 then 'source_closed' else 'other_non_success' end as outcome from orders)
select outcome, case outcome when 'exact_opening' then 0 when 'retryable_failure' then 4 when 'external_blocked' then 6 when 'source_closed' then 10 else 11 end as outcome_rank, count(*) as n from o group by 1, 2""",
    "agg20_first_missing": """
select case when coalesce(trim(lang), '') = '' then 'lang' when not coalesce(n_chars > 500, false) then 'long_text' when quality is null then 'quality' else 'none' end as missing, count(*) as n
from documents left join labels using (doc_id) group by 1""",
    "agg21_first_present": "select case when toxic = 1 then 'toxic' when quality = 1 then 'good' else nullif(trim(lang), '') end as label, count(*) as n from documents left join labels using (doc_id) group by 1",
    "agg24_route_venn": """
with m as (select user_id, bit_or(case when event_type = 'click' then 1 when event_type = 'purchase' and value > 90 then 2 when event_type = 'view' and value > 95 then 4 else 0 end) as mask from events group by 1)
select cast(c.mask as integer) as mask, count(m.user_id) as n from (select unnest(range(8)) as mask) c left join m on m.mask = c.mask group by 1""",
    "agg24_route_funnel": """
with r as (select l_returnflag, count(*) as t, count(*) filter (l_quantity > 10) as a, count(*) filter (l_quantity > 10 and l_discount > 0.02) as b, count(*) filter (l_quantity > 10 and l_discount > 0.02 and l_tax > 0.03) as c from lineitem group by 1)
select l_returnflag, 'input' as step, 0 as ord, a as passed, t as denominator from r union all select l_returnflag, 'candidate', 1, b, a from r union all select l_returnflag, 'board', 2, c, b from r""",
    "agg25_ledger_clusters": """
with g as (select event_type, cast(floor(value / 25) as bigint) as band, count(*) as n, count(distinct user_id) as companies from events group by 1, 2)
select *, companies >= 100 as qualified, cast(row_number() over (order by companies < 100, companies desc, event_type, band) as integer) as cluster_rank from g""",
    "agg29_count_map": "select event_type, count(*) as n from events group by 1",
    "agg30_blockers": "select case when max(o_totalprice) < 1e9 then 'open|price' else 'open' end as blockers from orders",
    "agg32_worst_reason": """
with r as (select user_id, case when event_type = 'click' then 'NETWORK_TIMEOUT' when event_type = 'purchase' then 'HTTP_FORBIDDEN' when value > 90 then 'CAPTCHA_REQUIRED' else 'FETCH_FAILED' end as c from events),
w as (select user_id, arg_min(c, case c when 'CAPTCHA_REQUIRED' then 0 when 'HTTP_FORBIDDEN' then 1 when 'NETWORK_TIMEOUT' then 2 else 3 end) as reason from r group by 1)
select reason, count(*) as n from w group by 1""",
    "agg33_merged_errors": """
select event_type, value > 50 as high, min(event_id) as first_ordinal, count(*) as n, string_agg(distinct cast(user_id % 7 as varchar), '|' order by cast(user_id % 7 as varchar)) as provenance from events group by 1, 2""",
    "agg34_by_priority": "select user_id, arg_min(event_type, case event_type when 'purchase' then '0' when 'click' then '1' else '2' || event_type end) as event_type from events group by 1",
    "agg36_distinct_counts": "select count(distinct url) as urls, count(distinct split_part(url, '/', 3)) as hosts, count(*) as n from pages",
    "agg37_accuracy": """
with r as (select cast(quality as varchar) as t, case when n_chars > 300 then case when n_chars > 1500 then '1' else '0' end end as g from documents join labels using (doc_id))
select count(*) as n, count(*) filter (t = g) as correct, count(*) filter (t <> g) as wrong, count(*) filter (g is null) as missing, 0 as must_reject from r""",
}
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("agg") and callable(f)}
