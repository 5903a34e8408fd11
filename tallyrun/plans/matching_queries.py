"""Queries that apply the joins, comparisons and scalar functions to the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import privacy, text, urls
from ..operators import matching as M
from .tables import table

RULES = (("suffix", "5", "five"), ("contains", "#3", "three"), ("regex", "[24]$", "even"), ("prefix", "Brand", "other"))
MIDDLE = "2024-01-16"


def joi01_checked_join(spark: SparkSession, d: str) -> DataFrame:
    return M.join_report(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")


def joi06_drift(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal") > 0)
    after = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal") > 0)
    found = M.drift(before.toDF("key", "nation", "solvent"), after.toDF("key", "nation", "solvent"), "key", ["nation", "solvent"])
    return found.select("key", "change", F.array_join("fields", ",").alias("fields"))


def joi07_excluding(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return M.excluding(table(spark, d, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


def joi09_text_mentions(spark: SparkSession, d: str) -> DataFrame:
    return M.mentions(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def joi10_lookup(spark: SparkSession, d: str) -> DataFrame:
    registry = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    found = M.lookup(table(spark, d, "nation").select("n_nationkey", "n_name"), registry, ["n_nationkey"], "s_name", 4)
    return found.select("n_nationkey", "n_name", "status", F.array_join("values", ",").alias("names"))


def joi13_positional_compare(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    replay = turns.filter("turn != 4").withColumn("role", F.when(F.col("turn") % 3 == 2, "changed").otherwise(F.col("role")))
    return M.positional_compare(turns, replay, "conv_id", "turn", "role")


def joi16_in_scopes(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("scope_id"), F.col("event_id").alias("sequence"))
    scopes = log.groupBy("scope_id").agg((F.min("sequence") + 100).alias("first"), (F.max("sequence") - 100).alias("last"))
    return M.in_scopes(log, scopes).groupBy("scope_id").agg(F.count("*").alias("n"))


def joi18_rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return parts.select(M.first_rule(parts, "p_brand", RULES).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def joi20_consume_once(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return M.consume_once(events.filter("event_type in ('view', 'click')"), events.filter("event_type not in ('view', 'click')"), ["user_id"], "event_id")


def set03_first_of_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return M.first_of_union([a, b], ["nation"], "name")


def set05_set_diff(spark: SparkSession, d: str) -> DataFrame:
    return M.set_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


def set07_all_covered(spark: SparkSession, d: str) -> DataFrame:
    required = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderstatus") == "F").alias("complete"))
    return M.all_covered(required, orders, ["k"], "complete")


def cmp01_run_deltas(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_type", "ts")
    return M.count_deltas(events.filter(F.col("ts") < F.lit(MIDDLE).cast("timestamp_ntz")), events.filter(F.col("ts") >= F.lit(MIDDLE).cast("timestamp_ntz")), "event_type")


def fn01_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.compare_key(F.col("url")).alias("compare_key"))


def fn07_domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").groupBy(urls.domain_of(url).alias("domain"), urls.path_depth(url).alias("depth")).agg(F.count("*").alias("n"))


def fn20_title_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.title_score(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias("score"))


def fn41_hash_rotation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", privacy.hash_bucket(7, F.col("c_name"), F.col("c_mktsegment")).cast("long").alias("bucket"))


def fn43_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", privacy.fingerprint(["c_name", "c_mktsegment"]).alias("fingerprint"))


def fn66_redact(spark: SparkSession, d: str) -> DataFrame:
    """Look-behind is beyond the SQL engine's patterns; the tests hold it against literals."""
    docs = table(spark, d, "documents").select("doc_id", "text", privacy.redact_body(F.col("text")).alias("redacted"))
    return docs.select("doc_id", (F.col("text") != F.col("redacted")).alias("changed"), F.sha2("redacted", 256).alias("redacted_sha256"))


def ext01_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(H.hrefs(F.col("html"))).alias("position", "href"))


def ext26_page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        joi01_checked_join, joi06_drift, joi07_excluding, joi09_text_mentions, joi10_lookup, joi13_positional_compare, joi16_in_scopes, joi18_rule_first_match,
        joi20_consume_once, set03_first_of_union, set05_set_diff, set07_all_covered, cmp01_run_deltas, fn01_canonical_url, fn07_domain_rollup, fn20_title_score,
        fn41_hash_rotation, fn43_fingerprint, fn66_redact, ext01_links, ext26_page_text,
    )
}

_TRACKING = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)
_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS)
_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) >= 2 and w not in ({_STOP})))"

ORACLES = {
    "joi01_checked_join": """
with a as (select o_custkey as k, count(*) as l from orders group by 1), b as (select c_custkey as k, count(*) as r from customer group by 1)
select cast(coalesce(sum(l * r), 0) as bigint) as matched, count(*) filter (where r is null) as left_only,
  count(*) filter (where l is null) as right_only, count(*) filter (where r > 1) as right_repeated from a full join b on a.k = b.k""",
    "joi06_drift": """
with a as (select c_custkey as key, c_nationkey as nation, c_acctbal > 0 as solvent from customer), b as (select s_suppkey as key, s_nationkey as nation, s_acctbal > 0 as solvent from supplier),
f as (select coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change,
  concat_ws(',', case when a.nation is distinct from b.nation then 'nation' end, case when a.solvent is distinct from b.solvent then 'solvent' end) as fields from a full join b on a.key = b.key)
select key, change, case when change = 'changed' then fields else '' end as fields from f where change <> 'changed' or fields <> ''""",
    "joi07_excluding": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%' and o_custkey is not null)",
    "joi09_text_mentions": "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) and length(b.text) > 0",
    "joi10_lookup": """
with r as (select s_nationkey, list_sort(list(distinct s_name)) as v from supplier group by 1)
select n_nationkey, n_name, case when v is null then 'not_found' when len(v) > 4 then 'ambiguous' else 'found' end as status,
  case when len(v) <= 4 then array_to_string(v, ',') end as names from nation left join r on n_nationkey = s_nationkey""",
    "joi13_positional_compare": """
with r as (select conv_id, turn, case when turn % 3 = 2 then 'changed' else role end as role from conversations where turn <> 4),
c as (select s.conv_id, s.turn, case when r.conv_id is null then 'missing_in_replay' when s.role is not distinct from r.role then 'reproduced' else 'mismatch' end as k
  from conversations s left join r on s.conv_id = r.conv_id and s.turn = r.turn),
e as (select *, max(cast(k = 'mismatch' as integer)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as m from c)
select conv_id, turn, case when k = 'mismatch' and m = 1 then 'divergence' else k end as class from e""",
    "joi16_in_scopes": """
with s as (select user_id, min(event_id) + 100 as a, max(event_id) - 100 as b from events group by 1)
select e.user_id as scope_id, count(*) as n from events e join s on e.user_id = s.user_id and event_id between a and b group by 1""",
    "joi18_rule_first_match": """
select case when ends_with(p_brand, '5') then 'five' when contains(p_brand, '#3') then 'three' when regexp_matches(p_brand, '[24]$') then 'even'
  when starts_with(p_brand, 'Brand') then 'other' end as label, count(*) as n from part group by 1""",
    "joi20_consume_once": """
with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type in ('view', 'click')),
b as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type not in ('view', 'click'))
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, b.n) as n, a.event_id as request_order, b.event_id as entry_order
  from a full join b on a.user_id = b.user_id and a.n = b.n""",
    "set03_first_of_union": """
with u as (select c_nationkey as nation, c_name as name, 0 as frame from customer where c_acctbal > 9000 union all select s_nationkey, s_name, 1 from supplier)
select nation, name, frame from u qualify row_number() over (partition by nation order by frame, name) = 1""",
    "set05_set_diff": """
with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders)
select count(*) filter (where a.k is null) as added, count(*) filter (where b.k is null) as removed, count(*) filter (where a.k = b.k) as common from a full join b on a.k = b.k""",
    "set07_all_covered": "select c_custkey as k from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_custkey is not null)",
    "cmp01_run_deltas": f"""
with c as (select event_type, count(*) filter (where ts < timestamp '{MIDDLE}') as before, count(*) filter (where ts >= timestamp '{MIDDLE}') as after from events group by 1)
select event_type, before, after, after - before as delta from c""",
    "fn01_canonical_url": f"""
with p as (select page_id, url, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)([?]([^#]*))?(#.*)?$', ['scheme', 'host', 'path', 'q', 'query', 'fragment']) as u from pages),
q as (select *, list_filter(string_split(u.query, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({_TRACKING})) as kept from p)
select page_id, lower(u.scheme) || '://' || lower(u.host) || rtrim(u.path, '/') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end || u.fragment as canonical,
  rtrim(regexp_replace(url, '[?#].*$', ''), '/') as compare_key from q""",
    "fn07_domain_rollup": r"""
select regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') as domain,
  cast(len(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) as integer) as depth, count(*) as n from pages group by 1, 2""",
    "fn20_title_score": f"""
with t as (select p_partkey, {_TOKENS.format("p_name")} as a, {_TOKENS.format("p_type || ' ' || p_name")} as b, lower(trim(p_name)) = lower(trim(p_type || ' ' || p_name)) as same from part),
c as (select *, len(list_intersect(a, b)) as n from t)
select p_partkey, cast(case when len(a) = 0 or len(b) = 0 then 0 else floor(70.0 * n / len(b) + 30.0 * n / len(a)) + case when same then 50 else 0 end end as integer) as score from c""",
    "fn41_hash_rotation": "select c_custkey, cast(cast('0x' || substr(sha256(c_name || chr(0) || c_mktsegment), 1, 16) as ubigint) % 7 as bigint) as bucket from customer",
    "fn43_fingerprint": """select c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') as fingerprint from customer""",
    "ext01_links": """
with l as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as a from pages),
e as (select page_id, unnest(a) as href, generate_subscripts(a, 1) as i from l), f as (select page_id, href, min(i) as i from e group by 1, 2)
select page_id, href, cast(row_number() over (partition by page_id order by i) - 1 as integer) as position from f qualify position < 200""",
    "ext26_page_text": r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title from pages",
}
