"""Queries over sources, sinks and structured data: files and pages made from the driver's tables, read back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured as X
from ..operators.shared import exploded, new_path, spread
from ..sources import files, sinks
from .tables import table


def src01_postings(spark: SparkSession, d: str) -> DataFrame:
    """The region table, five rows, as one wrapped document and one of the other form for its third row."""
    regions = table(spark, d, "region")
    posting = F.struct(F.col("r_name").alias("company_name"), F.lit("https://a.com/").alias("company_website_url"), F.concat(F.lit("t"), "r_regionkey").alias("linkedin_job_title"), F.lit(1).alias("other"))
    wrapped = regions.agg(F.to_json(F.struct(F.collect_list(posting).alias("postings"))).alias("value"))
    plain = regions.filter("r_regionkey = 3").agg(F.to_json(F.collect_list(posting)).alias("value"))
    path = new_path(spark, "postings")
    wrapped.coalesce(1).write.text(f"{path}/a")
    plain.coalesce(1).write.text(f"{path}/b")
    return files.sound_inputs(files.read_postings(spark, [f"{path}/a", f"{path}/b"])).select("company_name", "job_title")


def src03_reingested(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("company_name"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("https://www."), F.element_at(F.split("p_name", " "), 1), F.lit(".com/x"))).alias("company_website_url"),
        F.concat(F.lit("https://c/"), "p_partkey").alias("career_page_url"), F.col("p_type").alias("linkedin_job_title"),
    )
    return files.as_inputs(rows).select("company_name", "job_title", "career_root_url", "problem")


def src10_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "lines")
    table(spark, d, "labels").write.json(path)
    return files.read_json_lines(spark, path, "doc_id long, quality int, toxic int")


def src12_registry(spark: SparkSession, d: str) -> DataFrame:
    path, n = new_path(spark, "registry"), table(spark, d, "nation")
    rows = n.select(F.concat(F.lit("N"), "n_nationkey", F.lit(".gov")), F.lit("City"), F.concat("n_name", F.lit(', "x"')), F.lit(None).cast("string"), F.lit(" Town "), F.lit("CA"), F.lit("me@x.gov")).toDF(*files.REGISTRY_COLUMNS)
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return files.read_registry(spark, path).select("domain_name", "organization_name", "city")


def _search(spark: SparkSession, d: str, items: Column, f) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.explode(f(items)).alias("r"))
    return rows.select("p_partkey", "r.*")


def src13_feed_items(spark: SparkSession, d: str) -> DataFrame:
    item = lambda k: F.concat(F.lit("<item><title>A &amp; "), "p_name", F.lit(f"</title><link> https://a/{k}/"), "p_partkey", F.lit("</link><description><![CDATA[<b>x]]></description></item>"))
    return _search(spark, d, F.concat(F.lit("<rss>"), item(1), F.lit("<item><title>none</title></item>"), item(2), F.lit("</rss>")), X.feed_items)


def src16_search_hits(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct(F.concat(F.lit("https://a/"), "p_partkey").alias("url"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("content"))
    empty = F.struct(F.lit(" ").alias("url"), F.lit("x").alias("title"), F.lit("y").alias("content"))
    return _search(spark, d, F.to_json(F.struct(F.array(hit, empty).alias("results"))), X.search_hits)


def snk14_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('=x"'), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(", y"))).otherwise(F.col("p_type")).alias("v"))
    return sinks.csv_lines(rows, ["p_partkey", "v"])


def _posting_page() -> Column:
    place = F.struct(F.struct(F.col("p_brand").alias("addressLocality"), F.lit("OR").alias("addressRegion")).alias("address"))
    job = F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://a.com/"), "p_partkey")).alias("url"), place.alias("jobLocation"), F.struct(F.col("p_type").alias("name")).alias("hiringOrganization"))
    firm = F.struct(F.lit("Organization").alias("@type"), F.col("p_type").alias("name"), F.concat("p_type", F.lit(" Inc")).alias("legalName"))
    graph = F.concat(F.lit('{"@graph": ['), F.to_json(job), F.lit(","), F.to_json(firm), F.lit("]}"))
    head = F.concat(F.lit("<link rel='canonical' href='/p/"), "p_partkey", F.lit('\'><link rel="alternate" hreflang="en-US" href="/us/'), "p_partkey", F.lit('"><link rel="alternate" hreflang="de" href="/de"><meta http-equiv=refresh content="3;URL=/go/'), "p_partkey", F.lit('">'))
    return F.concat(head, F.lit('<script type="application/ld+json">'), graph, F.lit("</script><script type='application/ld+json'>{broken</script>"))


def ext07_job_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = exploded(spread(table(spark, d, "part")), X.job_postings(_posting_page(), F.lit("https://a.com/page#x")), "r")
    return rows.select("p_partkey", "r.*")


def ext19_organizations(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part")).select("p_partkey", F.posexplode_outer(X.organization_names(_posting_page())).alias("position", "name")).where("position is not null")


def ext28_page_links(spark: SparkSession, d: str) -> DataFrame:
    page = _posting_page()
    return table(spark, d, "part").select("p_partkey", X.canonical_link(page).alias("canonical"), F.array_join(X.alternate_links(page), ",").alias("alternates"), X.redirect_target(page).alias("target"))


def fn62_locations(spark: SparkSession, d: str) -> DataFrame:
    kinds = (
        "concat(p_brand, ' town')", """concat('["', p_brand, '", {"name": "', p_type, '"}, "', p_brand, '"]')""", """concat('{"address": {"city": "', p_brand, '", "state": "OR"}}')""",
        "'$ref:a_1'", "concat('[', array_join(array_repeat('\"x\"', 26), ','), ']')", """'{"country": "US"}'""",
    )
    raw = F.element_at(F.array(*map(F.expr, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.location_text(raw).alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        src01_postings, src03_reingested, src10_json_lines, src12_registry, src13_feed_items, src16_search_hits, snk14_csv_lines, ext07_job_postings, ext19_organizations, ext28_page_links, fn62_locations,
    )
}

ORACLES = {
    "src01_postings": "select r_name as company_name, 't' || r_regionkey as job_title from region union all select r_name, 't' || r_regionkey from region where r_regionkey = 3",
    "src03_reingested": """
with p as (select *, split_part(p_name, ' ', 1) as w, p_partkey % 3 <> 0 as site from part)
select case when p_partkey % 2 = 0 then p_name when site then upper(w[1]) || w[2:] end as company_name, p_type as job_title, 'https://c/' || p_partkey as career_root_url, case when not site then 'no_locator' end as problem from p""",
    "src10_json_lines": "select doc_id, cast(quality as integer) as quality, cast(toxic as integer) as toxic from labels",
    "src12_registry": """select 'n' || n_nationkey || '.gov' as domain_name, n_name || ', "x"' as organization_name, 'Town' as city from nation""",
    "src13_feed_items": "select p_partkey, 'https://a/' || k || '/' || p_partkey as url, 'A & ' || p_name as title, '<b>x' as snippet from part, (values (1), (2)) v(k)",
    "src16_search_hits": "select p_partkey, 'https://a/' || p_partkey as url, p_name as title, case when p_size > 20 then p_type else '' end as snippet from part",
    "snk14_csv_lines": """
select p_partkey || ',' || case p_partkey % 3 when 0 then '"''=x""' || p_name || '"' when 1 then '"' || p_name || ', y"' else p_type end as line from part""",
    "ext07_job_postings": """
select p_partkey, case when p_partkey % 2 = 0 then 'https://a.com/' || p_partkey else 'https://a.com/page' end as url, p_name as title, p_brand || ', OR' as location, p_type as organization from part""",
    "ext19_organizations": "select p_partkey, k as position, case k when 0 then p_type else p_type || ' Inc' end as name from part, (values (0), (1)) v(k)",
    "ext28_page_links": "select p_partkey, '/p/' || p_partkey as canonical, '/us/' || p_partkey as alternates, '/go/' || p_partkey as target from part",
    "fn62_locations": """
select p_partkey, case p_partkey % 6 when 0 then p_brand || ' town' when 1 then p_brand || '; ' || p_type when 2 then p_brand || ', OR' when 5 then 'US' end as place from part""",
}
