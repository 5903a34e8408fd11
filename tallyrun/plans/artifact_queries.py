"""Queries over captured sources, digest-bound artifacts and the run archive, on what is made of the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators.shared import new_path
from ..sources import captured
from .tables import table


def _responses(spark: SparkSession, d: str) -> tuple[str, str]:
    """The parts of each brand and size as one response: of odd sizes a feed, of even ones JSON; every tenth size is cut off."""
    groups = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("rows"))
    item = lambda r: F.concat(F.lit("<item><title>"), r["p_name"], F.lit(" &amp; co</title><link>https://f.com/"), r["p_partkey"].cast("string"), F.lit("</link><description>"), r["p_type"], F.lit("</description></item>"))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("rows", item), ""), F.lit("</channel></rss>"))
    hits = F.to_json(F.struct(F.transform("rows", lambda r: F.struct(F.concat(F.lit("https://h.com/"), r["p_partkey"].cast("string")).alias("url"), r["p_name"].alias("title"), r["p_type"].alias("content"))).alias("results")))
    cut = lambda c: F.when(F.col("p_size") % 10 == 0, F.expr("substring(body, 1, 30)")).otherwise(F.col("body"))
    out = []
    for name, body, odd in (("feeds", feed, 1), ("hits", hits, 0)):
        own = groups.where(F.col("p_size") % 2 == odd).select(F.concat_ws("|", "p_brand", "p_size").alias("query"), "p_size", body.alias("body"))
        path = new_path(spark, name)
        own.select("query", cut(own).alias("body"), F.current_timestamp().alias("captured_at")).write.parquet(path)
        out.append(path)
    return out[0], out[1]


def src17_captured_sources(spark: SparkSession, d: str) -> DataFrame:
    feeds, hits = _responses(spark, d)
    both = [captured.read_captured(spark, s, p).withColumn("source", F.lit(s.name())) for s, p in zip(captured.SOURCES, (feeds, hits), strict=True)]
    return both[0].unionByName(both[1]).drop("position")




def _changed() -> Column:
    """Content as it lies now: the price of some entries was changed after the next entry had taken their digest."""
    return F.when(F.col("o_orderkey") % 97 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))


def joi14_digest_chains(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a hash chain of manifests; some entries were changed later, some are gone."""
    text = lambda price: F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus", F.round(price * 100).cast("long"), "o_orderpriority"), 256)
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("target"), text(F.col("o_totalprice")).alias("taken"), text(_changed()).alias("digest"), (F.col("o_orderkey") % 89 == 5).alias("gone"))
    claims = A.successor_claims(orders, "o_custkey", ("o_orderdate", "target"), "target", "taken")
    return A.chain_report(A.link_states(claims, orders.where("not gone").select("target", "digest")))


def src23_file_union(spark: SparkSession, d: str) -> DataFrame:
    """Customers as text files, one a nation, read back with each file's name and digest; one nation's file is excluded."""
    path = new_path(spark, "files")
    line = F.concat_ws(",", "c_custkey", "c_mktsegment").alias("value")
    table(spark, d, "customer").select(line, F.concat(F.lit("n"), "c_nationkey").alias("nation")).repartition("nation").write.partitionBy("nation").text(path)
    files = A.file_digests(spark, path, ".txt")
    rows = A.tagged_lines(spark, path, files.where(~F.col("path").contains("nation=n7/")))
    return rows.select("value", F.length("sha256").alias("n_digest"))


def snk08_run_archive(spark: SparkSession, d: str) -> DataFrame:
    """Monthly counts of orders as runs: archived, archived again (nothing is added), one changed run added; then each against the latest of its kind."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    runs = table(spark, d, "orders").groupBy(month.alias("run"), "o_orderstatus").agg(F.count("*").alias("n")).withColumn("month", F.col("run"))
    path = new_path(spark, "archive")
    A.archive_runs(runs, "run", path, "w1")
    A.archive_runs(runs, "run", path, "w2")
    A.archive_runs(runs.where("run like '%-03'").withColumn("run", F.concat("run", F.lit("b"))).withColumn("n", F.col("n") + 1), "run", path, "w3")
    totals = A.archived(spark, path).groupBy("run").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    kinds = totals.withColumn("quarter", F.floor((F.substring("run", 6, 2).cast("int") - 1) / 3))
    return A.regressions(kinds, "run", "run", ("quarter",), ("n", "rows"))


QUERIES = {f.__name__: f for f in (src17_captured_sources, joi14_digest_chains, src23_file_union, snk08_run_archive)}

ORACLES = {
    "src17_captured_sources": """
select p_brand || '|' || p_size as query, case when p_size % 2 = 1 then 'https://f.com/' else 'https://h.com/' end || p_partkey as url, p_name || case when p_size % 2 = 1 then ' & co' else '' end as title,
  p_type as snippet, case when p_size % 2 = 1 then 'captured_feeds' else 'captured_hits' end as source from part where p_size % 10 <> 0""",
    "joi14_digest_chains": """
with o as (select o_custkey, o_orderkey, o_orderkey % 97 = 3 as changed, o_orderkey % 89 = 5 as gone, row_number() over w as r from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
l as (select o_custkey as chain, r + 1 as step, case when gone then 'missing' when changed then 'mismatch' end as status, r < count(*) over (partition by o_custkey) as linked from o)
select chain, count(*) as n_links, count(status) as n_broken, cast(min(step) filter (status is not null) as integer) as first_step, case when count(status) > 0 then 'previous' end as first_role,
  arg_min(status, step) filter (status is not null) as first_status from l where linked group by chain""",
    "src23_file_union": "select c_custkey || ',' || c_mktsegment as value, 64 as n_digest from customer where c_nationkey <> 7",
    "snk08_run_archive": """
with r as (select strftime(o_orderdate, '%Y-%m') as run, o_orderstatus, count(*) as n from orders group by 1, 2),
t as (select run, sum(n) as n, count(*) as rows from r group by run union all select run || 'b', sum(n + 1), count(*) from r where run like '%-03' group by run)
select run, lag(run) over w as baseline, cast(n - lag(n) over w as bigint) as delta_n, rows - lag(rows) over w as delta_rows from t
window w as (partition by (cast(substr(run, 6, 2) as integer) - 1) // 3 order by run)""",
}
