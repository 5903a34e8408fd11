"""Queries that apply the ordered operators to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import compare_key, host_of, path_depth
from ..operators import ordered as O
from .tables import table


def win01_strongest_per_key(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_depth(F.col("url")).alias("depth"))
    return O.top_ranked(O.strongest_per_key(pages, ["host"], [F.desc("depth"), "page_id"]), [F.desc("depth"), "page_id"], 50)


def win02_total_order(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    return O.top_ranked(parts, [F.desc("p_size"), "p_brand", F.lower("p_name"), "p_partkey"], 25).select("p_partkey", "position", "truncated")


def win03_family_slots(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", path_depth(F.col("url")).alias("tier"), host_of(F.col("url")).alias("family"))
    return O.family_slots(pages, "tier", "family", ["page_id"])


def win05_round_robin(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return O.round_robin(parts, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 60).select("p_partkey", "p_brand", "bucket_rank", "position", "truncated")


def win06_top_k(spark: SparkSession, d: str) -> DataFrame:
    return O.top_ranked(table(spark, d, "supplier").select("s_name", "s_acctbal"), [F.desc("s_acctbal"), "s_name"], 10).select("s_name", "position", "truncated")


def win07_reserved_topk(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return O.reserved_top(suppliers, "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")], 40).select("s_suppkey", "s_nationkey", "reserved", "position")


def win08_merged_routes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    found = O.merged_routes(events, "user_id", "event_type", [F.desc("value"), F.col("event_id")], 30)
    return found.select("user_id", "event_id", F.array_join("routes", "|").alias("routes"), "reserved", "position", "truncated")


def win09_greedy_quota(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    chosen = O.greedy_quota(orders, [("1-URGENT", 20), ("2-HIGH", 20), ("5-LOW", 10)], "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_custkey"])
    return chosen.select("o_orderkey", "o_custkey", "quota", "position")


def win10_first_seen(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return O.first_seen(events, "user_id", ["ts", "event_id"], 50).select("event_id", "user_id", "ordinal")


def win11_first_order(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return O.first_seen(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "ordinal")


def win12_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return O.strongest_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


def win13_durable_fold(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(
        "user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), "unresolved").otherwise(F.col("event_type")).alias("outcome"), (F.col("value") > 200).alias("accepted")
    )
    return O.durable_fold(events, "user_id", "event_id", "outcome", "accepted")


def win14_backoff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt"), "l_tax").distinct()
    return rows.select("attempt", "l_tax", F.round(O.backoff(F.col("attempt"), F.col("l_tax")), 6).alias("delay"))


def win16_unique_best(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_size", "p_type")
    return O.unique_best(parts, "p_brand", "p_size", "p_type").withColumn("ties", F.array_join("ties", "|"))


def win17_latest_compatible(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return O.latest_before(orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]).select("o_orderkey", "previous_o_orderkey")


def win18_first_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return O.first_event(events, "user_id", ["ts", "event_id"], (F.col("event_type") == "purchase") & (F.col("value") > 100)).select("user_id", "event_id")


def win19_valid_prefix(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return O.valid_prefix(turns, "conv_id", ["turn"], F.col("n") < 400)


def srt03_names_per_group(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_nationkey", "c_name")
    return O.top_per_group(customers, ["c_nationkey"], [F.lower("c_name"), F.col("c_name")], 20)


def srt05_distinct_casefold(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", F.array_join(O.distinct_casefold(words), " ").alias("words"))


def srt07_distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(compare_key(F.col("url")), r"/[^/]*$", "").alias("key"))
    return O.first_seen(pages, "key", ["page_id"]).select("page_id", "key", "ordinal")


def srt08_priority_union(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("ord"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).otherwise("").alias("text"))
    frames = [orders.filter("text <> ''").filter("ord % 2 = 0"), orders.filter("ord % 2 = 1")]
    return O.priority_union(frames, "o_orderpriority", "text", 3, "o_custkey").select("o_custkey", "o_orderpriority", "ord", "text", "priority", "position")


def _top(order: str, n: int, rows: str, columns: str) -> str:
    return f"select {columns}, cast(row_number() over (order by {order}) as integer) as position, count(*) over () > {n} as truncated from {rows} qualify row_number() over (order by {order}) <= {n}"


_HOST = "lower(split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':', 1))"
_DEPTH = "len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''))"

ORACLES = {
    "win01_strongest_per_key": f"with p as (select page_id, {_HOST} as host, cast({_DEPTH} as integer) as depth from pages qualify row_number() over (partition by {_HOST} order by {_DEPTH} desc, page_id) = 1) "
    + _top("depth desc, page_id", 50, "p", "page_id, host, depth"),
    "win02_total_order": _top("p_size desc, p_brand, lower(p_name), p_partkey", 25, "part", "p_partkey"),
    "win03_family_slots": f"select page_id, cast({_DEPTH} as integer) as tier, {_HOST} as family, row_number() over (partition by {_DEPTH}, {_HOST} order by page_id) > 1 as alias from pages",
    "win05_round_robin": "with p as (select p_partkey, p_brand, cast(row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as integer) as bucket_rank, p_retailprice from part) "
    + _top("bucket_rank, p_brand, p_retailprice desc, p_partkey", 60, "p", "p_partkey, p_brand, bucket_rank"),
    "win06_top_k": _top("s_acctbal desc, s_name", 10, "supplier", "s_name"),
    "win07_reserved_topk": """
with r as (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) = 1 as reserved from supplier),
c as (select * from r qualify row_number() over (order by reserved desc, s_acctbal desc, s_suppkey) <= 40)
select s_suppkey, s_nationkey, reserved, cast(row_number() over (order by s_acctbal desc, s_suppkey) as integer) as position from c""",
    "win08_merged_routes": """
with g as (select user_id, string_agg(distinct event_type, '|' order by event_type) as routes from events group by 1),
b as (select * from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1),
v as (select distinct user_id from (select * from events qualify row_number() over (partition by event_type order by value desc, event_id) = 1)),
r as (select b.user_id, b.event_id, b.value, routes, v.user_id is not null as reserved from b join g using (user_id) left join v using (user_id))
"""
    + _top("reserved desc, value desc, event_id", 30, "r", "user_id, event_id, routes, reserved"),
    "win09_greedy_quota": """
with a as (select * from orders where o_orderpriority = '1-URGENT' qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1),
a1 as (select *, row_number() over (order by o_totalprice desc, o_orderkey) as p from a qualify p <= 20),
b as (select * from orders where o_orderpriority = '2-HIGH' and o_custkey not in (select o_custkey from a1) qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1),
b1 as (select *, row_number() over (order by o_totalprice desc, o_orderkey) as p from b qualify p <= 20),
c as (select * from orders where o_orderpriority = '5-LOW' and o_custkey not in (select o_custkey from a1 union select o_custkey from b1) qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1),
c1 as (select *, row_number() over (order by o_totalprice desc, o_orderkey) as p from c qualify p <= 10)
select o_orderkey, o_custkey, 0 as quota, cast(p as integer) as position from a1 union all select o_orderkey, o_custkey, 1, cast(p as integer) from b1 union all select o_orderkey, o_custkey, 2, cast(p as integer) from c1""",
    "win10_first_seen": """
with f as (select * from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)
select event_id, user_id, cast(row_number() over (order by ts, event_id) as integer) as ordinal from f qualify ordinal <= 50""",
    "win11_first_order": """
with f as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1)
select o_orderkey, o_custkey, row_number() over (order by o_orderdate, o_orderkey) as ordinal from f""",
    "win12_latest_wins": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "win13_durable_fold": """
with e as (select user_id, event_id, case when event_type in ('click', 'view') then 'unresolved' else event_type end as v, value > 200 as a, row_number() over (partition by user_id order by event_id) as i, count(*) over (partition by user_id) as n from events),
x as (select *, bool_or((i = 1 or a) and v <> 'unresolved') over (partition by user_id order by i rows between unbounded preceding and 1 preceding) as fixed from e),
t as (select * from x where i = 1 or a or (v = 'unresolved' and (select max(y.i) from x y where y.user_id = x.user_id and y.i < x.i and (y.i = 1 or y.a)) is not null
  and (select arg_max(y.v, y.i) from x y where y.user_id = x.user_id and y.i < x.i and (y.i = 1 or y.a)) = 'unresolved'))
select user_id, arg_max(v, i) as outcome, max(event_id) as ordinal, cast(max(n) - 1 as integer) as later from t group by 1""",
    "win14_backoff": "select distinct l_linenumber as attempt, l_tax, round(least(8.0, 0.25 * pow(2.0, l_linenumber)) * (1 + 0.25 * (2 * l_tax - 1)), 6) as delay from lineitem",
    "win16_unique_best": """
with t as (select distinct p_brand, p_size, p_type from part qualify p_size = max(p_size) over (partition by p_brand)),
g as (select p_brand, p_size, count(*) as n, min(p_type) as one, list_sort(list(p_type))[1:8] as ties from t group by 1, 2)
select p_brand, p_size, case when n = 1 then one end as best, n > 1 as ambiguous, case when n > 1 then array_to_string(ties, '|') end as ties from g""",
    "win17_latest_compatible": "select o_orderkey, lag(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as previous_o_orderkey from orders",
    "win18_first_event": "select user_id, event_id from events where event_type = 'purchase' and value > 100 qualify row_number() over (partition by user_id order by ts, event_id) = 1",
    "win19_valid_prefix": """
with t as (select conv_id, sum(case when length(text) < 400 then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) as bad from conversations)
select conv_id, count(*) filter (bad = 0) as prefix, count(*) as n, count(*) filter (bad = 0) = count(*) as complete from t group by 1""",
    "srt03_names_per_group": "select c_nationkey, c_name, cast(row_number() over (partition by c_nationkey order by lower(c_name), c_name) as integer) as position from customer qualify position <= 20",
    "srt05_distinct_casefold": """
with w as (select item_id, string_split(text, ' ') as w from benchmark), u as (select item_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
f as (select item_id, arg_min(x, i) as x, min(i) as i from u group by item_id, lower(x))
select item_id, string_agg(x, ' ' order by i) as words from f group by 1""",
    "srt07_distinct_urls": """
with p as (select page_id, regexp_replace(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '/[^/]*$', '') as key from pages), f as (select key, min(page_id) as page_id from p group by 1)
select page_id, key, row_number() over (order by page_id) as ordinal from f""",
    "srt08_priority_union": """
with o as (select o_custkey, o_orderpriority, o_orderkey as ord, case when o_totalprice > 100000 then o_orderstatus else '' end as text from orders),
r as (select *, 0 as priority from o where text <> '' and ord % 2 = 0 union all select *, 1 from o where ord % 2 = 1),
f as (select o_custkey, o_orderpriority, arg_min(ord, priority * 1e12 + ord) as ord, coalesce(arg_min(text, priority * 1e12 + ord) filter (trim(text) <> ''), arg_min(text, priority * 1e12 + ord)) as text, min(priority) as priority from r group by 1, 2)
select *, cast(row_number() over (partition by o_custkey order by priority, ord) as integer) as position from f qualify position <= 3""",
}
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("win", "srt")) and callable(f)}
