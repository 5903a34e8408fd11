"""Queries over board payloads and JSON of any shape, made from the driver's tables as text and read back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators.shared import exploded, new_path, spread
from ..sources import boards
from .tables import table

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def _board() -> Column:
    return F.concat(F.lit("https://jobs.example.com/b"), F.col("l_suppkey"))


def _items() -> Column:
    """A lineitem as a posting in the form of its supplier's provider; the seventh lines have a blank title."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey")
    title = F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat(F.lit("Role "), "l_partkey"))
    town = F.concat(F.lit("Town "), "l_linestatus")
    forms = [
        F.struct(title.alias("title"), F.concat(F.lit("/job/"), key).alias("externalPath"), town.alias("locationsText")),
        F.struct(title.alias("title"), F.concat(_board(), F.lit("/"), key).alias("absolute_url"), F.struct(town.alias("name")).alias("location")),
        F.struct(title.alias("text"), F.concat(_board(), F.lit("/"), key).alias("hostedUrl"), F.struct(town.alias("location")).alias("categories")),
        F.struct(title.alias("name"), key.alias("id"), F.struct(town.alias("city")).alias("location")),
    ]
    return F.element_at(F.array(*map(F.to_json, forms)), (F.col("l_suppkey") % 4 + 1).cast("int"))


def captured_boards(spark: SparkSession, d: str) -> DataFrame:
    """Every lineitem as a posting on its supplier's board, 20 a page; boards of four providers, some without their last page or with a broken second one."""
    every = Window.partitionBy("l_suppkey")
    rows = table(spark, d, "lineitem").withColumns({"k": F.row_number().over(every.orderBy(*_ORDER)) - 1, "n": F.count("*").over(every)})
    whole = F.col("l_suppkey") % 4 == 2
    paged = rows.select("l_suppkey", "n", "k", F.when(whole, 0).otherwise(F.floor(F.col("k") / 20)).alias("page"), _items().alias("item"))
    pages = paged.groupBy("l_suppkey", "n", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), ",").alias("list"))
    lost = ~whole & (F.col("l_suppkey") % 5 == 1) & (F.col("page") > 0) & (F.col("page") == F.floor((F.col("n") - 1) / 20))
    bodies = [
        F.concat(F.lit('{"jobPostings":['), "list", F.lit('],"total":'), "n", F.lit("}")), F.concat(F.lit('{"jobs":['), "list", F.lit('],"meta":{"total":'), "n", F.lit("}}")),
        F.concat(F.lit("["), "list", F.lit("]")), F.concat(F.lit('{"totalFound":'), "n", F.lit(',"content":['), "list", F.lit("]}")),
    ]
    body = F.element_at(F.array(*bodies), (F.col("l_suppkey") % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("workday", "greenhouse", "lever", "smartrecruiters"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    broken = ~whole & (F.col("l_suppkey") % 7 == 2) & (F.col("page") == 1)
    made = spread(pages.where(~lost)).select(F.col("l_suppkey").alias("board"), name.alias("provider"), "page", _board().alias("board_url"), F.when(broken, F.substring(body, 1, 40)).otherwise(body).alias("body"))
    path = new_path(spark, "boards")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def src_boards_postings(spark: SparkSession, d: str) -> DataFrame:
    return boards.read_boards(captured_boards(spark, d), boards.provider_table(spark))[0]


def src_boards_inventory(spark: SparkSession, d: str) -> DataFrame:
    return boards.read_boards(captured_boards(spark, d), boards.provider_table(spark))[1]


def ext09_inventories(spark: SparkSession, d: str) -> DataFrame:
    """Parts by brand and size as a site's inventory; every tenth size has a record without a title, every third a wrong count."""
    blank = (F.col("p_size") % 10 == 0) & (F.col("p_partkey") % 2 == 0)
    record = F.struct(F.when(blank, "").otherwise(F.col("p_name")).alias("Title"), F.col("p_partkey").alias("ID"), F.col("p_type").alias("city"), F.lit("OR").alias("state"))
    groups = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.collect_list(record).alias("records"))
    total = F.size("records") + F.when(F.col("p_size") % 3 == 0, 1).otherwise(0)
    body = F.to_json(F.struct("records", total.alias("count")))
    template = F.lit("https://jobs.example.com/p/{id}/{slug}")
    read = boards.inventory_payloads(groups.select("p_brand", "p_size", body.alias("body")), F.col("body"), F.lit("https://jobs.example.com/api"), template, F.lit(True))
    return exploded(read, F.col("rows"), "row").select("p_brand", "p_size", "total", "complete", "row.*")


def ext21_provider_rows(spark: SparkSession, d: str) -> DataFrame:
    """One payload a part, in the form of one of three providers, or of none."""
    name, key = F.col("p_name"), F.col("p_partkey")
    bodies = [
        F.to_json(F.struct(F.array(F.struct(name.alias("title"), F.concat(F.lit("https://a.com/j/"), key).alias("absolute_url")), F.struct(name.alias("title"), F.lit(None).cast("string").alias("absolute_url"))).alias("jobs"))),
        F.to_json(F.array(F.struct(name.alias("text"), F.when(key % 3 == 0, F.concat(F.lit("https://a.com/h/"), key)).alias("hostedUrl"), F.concat(F.lit("https://a.com/a/"), key).alias("applyUrl")))),
        F.to_json(F.struct(F.array(F.struct(name.alias("jobOpeningName"), key.alias("id"))).alias("result"))), F.lit('{"jobs":'),
    ]
    k = (key % 4 + 1).cast("int")
    provider = F.element_at(F.array(*map(F.lit, ("greenhouse", "lever", "bamboohr", "ashby"))), k)
    payloads = table(spark, d, "part").select(key.alias("board"), provider.alias("provider"), F.lit("https://b.com/careers/").alias("board_url"), F.element_at(F.array(*bodies), k).alias("body"))
    return boards.provider_rows(payloads, boards.provider_table(spark)).select(F.col("board").alias("p_partkey"), "title", "url")


def fn64_job_records(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a posting, as deep in an object as its size and key say: by type under any name, by its place in a container of postings."""
    depth = (F.col("p_size") + F.col("p_partkey")) % 30
    typed = F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"))
    placed = F.struct(F.array(F.struct(F.col("p_name").alias("name"))).alias("openings"))
    inner = F.when(F.col("p_partkey") % 2 == 0, F.to_json(typed)).otherwise(F.to_json(placed))
    nested = F.concat(F.expr("repeat('{\"x\":', cast((p_size + p_partkey) % 30 as int))"), inner, F.expr("repeat('}', cast((p_size + p_partkey) % 30 as int))"))
    parts = spread(table(spark, d, "part")).select("p_partkey", depth.alias("depth"), nested.alias("body"))
    return exploded(parts, V.job_records(F.try_parse_json("body")), "r").select("p_partkey", "depth", V.first_text(F.col("r"), ("title", "name")).alias("title"))


QUERIES = {f.__name__: f for f in (src_boards_postings, src_boards_inventory, ext09_inventories, ext21_provider_rows, fn64_job_records)}

_CAPTURED = """
with r as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 as k,
  count(*) over (partition by l_suppkey) as n from lineitem),
p as (select *, l_suppkey % 4 = 2 as whole, case when l_suppkey % 4 = 2 then 0 else k // 20 end as page, (n - 1) // 20 as last from r),
c as (select *, not whole and l_suppkey % 7 = 2 and page >= 1 as broken from p where whole or not (l_suppkey % 5 = 1 and page > 0 and page = last))"""

ORACLES = {
    "src_boards_postings": _CAPTURED + """
select l_suppkey as board, ['workday', 'greenhouse', 'lever', 'smartrecruiters'][l_suppkey % 4 + 1] as provider, page, case when whole then k else k % 20 end as position,
  'Role ' || l_partkey as title, 'https://jobs.example.com/b' || l_suppkey || case when l_suppkey % 4 = 0 then '/job/' else '/' end || l_orderkey || '-' || l_partkey as url,
  'Town ' || l_linestatus as location
from c where not broken and l_linenumber <> 7""",
    "src_boards_inventory": _CAPTURED + """
select l_suppkey as board, ['workday', 'greenhouse', 'lever', 'smartrecruiters'][l_suppkey % 4 + 1] as provider, count(distinct page) filter (page <= 1 or not broken) as n_pages,
  count(*) filter (not broken) as n_records, case when not any_value(whole) then max(n) end as total, not bool_or(broken) and count(*) = max(n) as complete,
  count(*) filter (not broken and l_linenumber <> 7) as n_listed,
  case when count(*) filter (not broken and l_linenumber <> 7) > 0 then null when bool_or(broken) then 'INVALID_STRUCTURED_DATA' else 'EMPTY_PROVIDER_RESPONSE' end as reason
from c group by l_suppkey""",
    "ext09_inventories": """
with g as (select p_brand, p_size, count(*) + case when p_size % 3 = 0 then 1 else 0 end as total, count(*) as n, bool_or(p_size % 10 = 0 and p_partkey % 2 = 0) as bad from part group by 1, 2)
select p_brand, p_size, total, total = n as complete, p_name as title,
  'https://jobs.example.com/p/' || p_partkey || '/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as url, p_type || ', OR' as location
from part join g using (p_brand, p_size) where not bad""",
    "ext21_provider_rows": """
select p_partkey, p_name as title, case p_partkey % 4 when 0 then 'https://a.com/j/' when 1 then case when p_partkey % 3 = 0 then 'https://a.com/h/' else 'https://a.com/a/' end
  else 'https://b.com/careers/' end || p_partkey as url from part where p_partkey % 4 < 3""",
    "fn64_job_records": """
select p_partkey, (p_size + p_partkey) % 30 as depth, p_name as title from part where (p_size + p_partkey) % 30 + case when p_partkey % 2 = 0 then 0 else 2 end <= 24""",
}
