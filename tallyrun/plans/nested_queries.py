"""Queries over nested arrays, walks over pages and tagged unions: orders with their lines as evidence, customers' orders as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import ordered as O
from ..operators import summaries as S
from .tables import table

MOST_PAGES = 5


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines, a handful each, as an array of evidence in order."""
    item = F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("state"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def agg08_exploded_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.exploded_counts(_evidence(spark, d), "evidence", "kind", "state")


def agg09_first_evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.first_evidence_counts(_evidence(spark, d), "evidence", "R", "state")


def agg10_first_accepted_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.first_evidence_counts(_evidence(spark, d), "evidence", "A", "state")


def set01_tagged_union(spark: SparkSession, d: str) -> DataFrame:
    names = {"customers": ("customer", "c_name", "c_acctbal"), "suppliers": ("supplier", "s_name", "s_acctbal")}
    return M.tagged_union({tag: table(spark, d, t).select(F.col(n).alias("name"), F.col(b).alias("balance")) for tag, (t, n, b) in names.items()})


def win15_page_walk(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as pages; some lead back to themselves."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pages = table(spark, d, "orders").withColumns({"page": F.row_number().over(own), "last": F.lead("o_orderkey").over(own).isNull()})
    onward = F.when(F.col("o_orderkey") % 11 == 0, F.col("page")).when(~F.col("last"), F.col("page") + 1)
    walked = pages.select("o_custkey", "page", onward.alias("next_page"), F.array(F.struct(F.col("o_orderpriority").alias("title"))).alias("items"))
    return O.page_walk(walked, "o_custkey", "page", "next_page", "items", "title", MOST_PAGES)


QUERIES = {f.__name__: f for f in (agg08_exploded_counts, agg09_first_evidence_counts, agg10_first_accepted_counts, set01_tagged_union, win15_page_walk)}

_FIRST = """
with r as (select l_orderkey, l_linestatus, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_linestatus) as r from lineitem where l_returnflag = '{}')
select l_linestatus as state, count(*) as n from r where r = 1 group by 1"""

ORACLES = {
    "agg08_exploded_counts": "select l_returnflag as kind, l_linestatus as state, count(*) as n from lineitem group by 1, 2",
    "agg09_first_evidence_counts": _FIRST.format("R"),
    "agg10_first_accepted_counts": _FIRST.format("A"),
    "set01_tagged_union": "select c_name as name, c_acctbal as balance, 'customers' as source from customer union all select s_name, s_acctbal, 'suppliers' from supplier",
    "win15_page_walk": f"""
with p as (select o_custkey, o_orderkey, o_orderpriority, row_number() over w as r, lead(o_orderkey) over w is null as last from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
s as (select *, case when o_orderkey % 11 = 0 then 'cycle' when last then 'end' when r >= {MOST_PAGES} then 'cap' end as stop from p),
f as (select o_custkey, min(r) filter (stop is not null) as r from s group by 1)
select s.o_custkey, cast(f.r as integer) as pages, count(distinct o_orderpriority) as items, max(stop) as stop from s join f on s.o_custkey = f.o_custkey and s.r <= f.r group by 1, 2""",
}
