"""Job boards of any provider as rows: one reader, one row of paths a provider.

A provider is described by where its payload keeps the list of postings, their titles, urls and places, and the number of postings it claims to
have; adding a provider adds a row.  Payloads are VARIANT, so shapes of any nesting go through one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structured as X
from ..functions import variants as V
from ..functions.urls import safe_normalize_url
from ..operators.shared import exploded, spread

PROVIDER_SCHEMA = "provider string, items string, total string, titles array<string>, urls array<string>, template string, id string, places array<string>, page_size int"
# The payload paths of public board interfaces.  Templates make a url from the board's and an id.
PROVIDERS = (
    ("applicantpro", "$.data.jobs", "$.data.jobCount", ["$.title"], ["$.jobUrl", "$.url"], None, None, ["$.location", "$.city"], None),
    ("ashby", "$.jobs", None, ["$.title"], ["$.jobUrl", "$.applyUrl"], "{board}/{id}", "$.id", ["$.location", "$.locationName"], None),
    ("bamboohr", "$.result", "$.meta.totalCount", ["$.jobOpeningName"], [], "{board}/{id}", "$.id", ["$.location", "$.atsLocation"], None),
    ("eightfold", "$.positions", "$.count", ["$.name"], ["$.canonicalPositionUrl"], None, None, ["$.location", "$.locations"], 10),
    ("greenhouse", "$.jobs", "$.meta.total", ["$.title"], ["$.absolute_url"], None, None, ["$.location.name", "$.location"], None),
    ("healthcaresource", "$.jobs", "$.meta.total", ["$.title"], ["$.url"], None, None, ["$.location"], None),
    ("lever", "$", None, ["$.text"], ["$.hostedUrl", "$.applyUrl"], None, None, ["$.categories.location"], None),
    ("oracle_hcm", "$.items[0].requisitionList", "$.items[0].TotalJobsCount", ["$.Title"], [], "{board}/job/{id}", "$.Id", ["$.PrimaryLocation"], None),
    ("pinpoint", "$.data", None, ["$.title"], ["$.url"], None, None, ["$.location.name", "$.location"], None),
    ("saashr", "$.jobs", "$.paging.total", ["$.title"], ["$.url"], None, None, ["$.location"], 100),
    ("smartrecruiters", "$.content", "$.totalFound", ["$.name"], [], "{board}/{id}", "$.id", ["$.location"], 100),
    ("taleo", "$.requisitionList", "$.pagingData.totalCount", ["$.column[0]"], [], "{board}/jobdetail.ftl?job={id}", "$.jobId", ["$.column[1]"], 25),
    ("ultipro", "$.opportunities", "$.totalCount", ["$.Title"], [], "{board}/OpportunityDetail?opportunityId={id}", "$.Id", ["$.Locations"], None),
    ("workable", "$.results", "$.total", ["$.title"], ["$.url"], "{board}/j/{id}", "$.shortcode", ["$.location"], None),
    ("workday", "$.jobPostings", "$.total", ["$.title"], [], "{board}{id}", "$.externalPath", ["$.locationsText"], 20),
)


def provider_table(spark: SparkSession, rows: Sequence[tuple] = PROVIDERS) -> DataFrame:
    return spark.createDataFrame(list(rows), PROVIDER_SCHEMA)


def _known(providers: DataFrame) -> dict[str, list[str]]:
    """The distinct paths in each column of the provider table, which is small: so many rows as there are kinds of boards."""
    rows = providers.select("items", "total", "id", "titles", "urls", "places").distinct().collect()
    cells = {c: [x for r in rows if r[c] is not None for x in ([r[c]] if isinstance(r[c], str) else r[c])] for c in ("items", "total", "id", "titles", "urls", "places")}
    return {c: sorted({x for x in paths if x is not None}) for c, paths in cells.items()}


def _at(value: Column, path: Column, known: Sequence[str]) -> Column:
    """The value at a path that is one of the known ones, which are constants of the plan: a path from a column would be parsed for every row."""
    return reduce(lambda acc, p: acc.when(path == p, F.try_variant_get(value, p, "variant")), known, F.when(F.lit(False), value))


def _first(value: Column, paths: Column, known: Sequence[str], f) -> Column:
    """The first of the paths (an array column) with a value that ``f`` takes."""
    return F.get(F.filter(F.transform(paths, lambda p: f(_at(value, p, known))), lambda x: x.isNotNull()), F.lit(0))


def listed(pages: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per posting of a captured page that has a title and a sound url: board, provider, page, position, title, url, location.

    ``pages`` has board, provider, page (its order), board_url and body (JSON text).
    """
    known = _known(providers)
    read = spread(pages).join(F.broadcast(providers), "provider").withColumn("_json", F.try_parse_json("body"))
    read = read.withColumn("items", _at(F.col("_json"), F.col("items"), known["items"]))
    item = read.select("board", "provider", "page", "board_url", "titles", "urls", "template", "id", "places", F.posexplode_outer(V.elements(F.col("items"))).alias("position", "item")).where("position is not null")
    board = F.regexp_replace("board_url", r"/+$", "")
    made = F.replace(F.replace("template", F.lit("{board}"), board), F.lit("{id}"), V.plain(_at(F.col("item"), F.col("id"), known["id"])))
    # each step is a projection of its own, so what a later one uses more than once is worked out once
    found = item.select(
        "board", "provider", "page", "position", "board_url", _first(F.col("item"), F.col("titles"), known["titles"], V.plain).alias("title"),
        F.coalesce(_first(F.col("item"), F.col("urls"), known["urls"], V.plain), F.when(F.col("id").isNotNull(), made)).alias("url"), _first(F.col("item"), F.col("places"), known["places"], V.raw).alias("place"),
    )
    row = F.struct("title", safe_normalize_url(F.col("url"), F.col("board_url")).alias("url"), X.location_text(F.col("place")).alias("location"))
    sound = F.filter(F.array(row), lambda r: r["title"].isNotNull() & r["url"].isNotNull())
    return exploded(found, sound, "row").select("board", "provider", "page", "position", "row.*")


def page_states(pages: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per page: board, page, n (its items, null where the payload has no list), seen and total so far, and ``ends``: complete, broken or null.

    Pages are read in order up to the first that is broken (no JSON, or no list where the provider keeps it) or that shows the board is complete:
    an empty page, a short one where no total is claimed, or one that reaches the highest total claimed so far.
    """
    known = _known(providers)
    # a body is parsed once, and the count of its list is read off that
    read = spread(pages).join(F.broadcast(providers), "provider").withColumn("_json", F.try_parse_json("body"))
    read = read.select(
        "board", "provider", "page", "page_size", F.size(V.elements(_at(F.col("_json"), F.col("items"), known["items"]))).alias("n"),
        _at(F.col("_json"), F.col("total"), known["total"]).alias("_total"),
    )
    total = V.plain(F.col("_total")).try_cast("long")
    slim = read.select("board", "provider", "page", "page_size", "n", F.when(total >= 0, total).alias("claimed"))
    slim = slim.withColumn("n", F.when(F.col("n") >= 0, F.col("n")))
    so_far = Window.partitionBy("board").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = slim.withColumns({"seen": F.sum("n").over(so_far), "total": F.max("claimed").over(so_far)})
    done = (F.col("n") == 0) | F.when(F.col("total").isNull(), F.col("page_size").isNull() | (F.col("n") < F.col("page_size"))).otherwise(F.col("seen") >= F.col("total"))
    return run.withColumn("ends", F.when(F.col("n").isNull(), "broken").when(done, "complete"))


def read_boards(pages: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, boards): the listed postings of the pages that count, and per board provider, n_pages, n_records, n_listed, total, complete and reason.

    A board's reason is null where it lists a posting, else INVALID_STRUCTURED_DATA for a broken page or EMPTY_PROVIDER_RESPONSE.
    Only slim rows are ordered within a board; its payloads stay where they are.
    """
    states = page_states(pages, providers)
    ends = states.groupBy("board").agg(F.min(F.when(F.col("ends").isNotNull(), F.struct("page", "ends"))).alias("end"))
    last = F.coalesce(F.col("end.page"), F.lit(2**62))
    counted = states.join(ends, "board").where(F.col("page") <= last)
    boards = counted.groupBy("board", "provider").agg(
        F.count("*").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.max("claimed").alias("total"),
        F.coalesce(F.first("end.ends") == "complete", F.lit(False)).alias("complete"), F.count_if(F.col("ends") == "broken").alias("broken"),
    )
    rows = listed(pages, providers).join(ends, "board").where(F.col("page") <= last).drop("end")
    n = rows.groupBy("board").agg(F.count("*").alias("n_listed"))
    reason = F.when(F.col("n_listed") > 0, F.lit(None)).when(F.col("broken") > 0, "INVALID_STRUCTURED_DATA").otherwise("EMPTY_PROVIDER_RESPONSE")
    return rows, boards.join(n, "board", "left").fillna(0, ["n_listed"]).withColumn("reason", reason).drop("broken")


def provider_rows(payloads: DataFrame, providers: DataFrame) -> DataFrame:
    """The listed (title, url) rows of single payloads (board, provider, board_url, body), one a posting, duplicates included."""
    return listed(payloads.withColumn("page", F.lit(0)), providers).drop("page", "location")


# Where a site's own inventory keeps its records, its count and a record's fields.
RECORD_LISTS = ("jobs", "data", "records", "Records")
RECORD_TOTALS = ("total", "count", "TotalRecordCount")
RECORD_URLS = ("url", "Url", "jobUrl", "detailUrl")
RECORD_PLACES = ("metro", "locationName", "jobLocation", "location", "Location")
RECORD_PLACE_PARTS = ("city", "state", "region", "country")
MOST_TITLE, MOST_PLACE = 300, 500


def _texts(record: Column, fields: Sequence[str]) -> Column:
    """The distinct texts, not blank, of an object's string fields."""
    text = lambda f: F.when(F.schema_of_variant(V.member(record, f)) == "STRING", V.plain(V.member(record, f)))
    return F.array_distinct(F.filter(F.array(*map(text, fields)), lambda x: x.isNotNull()))


def inventory_payloads(payloads: DataFrame, body: Column, endpoint: Column, template: Column, hint: Column) -> DataFrame:
    """The payloads with the columns rows (array(struct(title, url, location))), total and complete of a site's own JSON inventory.

    The payload is a list, or an object with exactly one list among ``RECORD_LISTS`` and at most one whole number among
    ``RECORD_TOTALS``.  A record has one title and one url, or an id that ``template`` turns into one (``{id}``, ``{slug}``).  Urls are
    resolved against the endpoint and listed once.  Unless every record is sound there are no rows, no total and it is not complete.  It is
    complete where the total equals the number of records, or, with no total, where ``hint`` says so.
    """
    value = F.col("_value")
    read = payloads.withColumns({"_value": F.try_parse_json(body), "_endpoint": endpoint, "_template": template, "_hint": hint})
    present = lambda fields: F.filter(F.array(*[V.member(value, f) for f in fields]), lambda x: x.isNotNull())
    read = read.withColumns({"_lists": present(RECORD_LISTS), "_counts": present(RECORD_TOTALS)})
    count, single = F.get("_counts", F.lit(0)), F.get("_lists", F.lit(0))
    read = read.withColumn("total", F.when(F.schema_of_variant(count) == "BIGINT", F.try_variant_get(count, "$", "long")))
    counted = (F.size("_counts") == 0) | (F.size("_counts") == 1) & (F.col("total") >= 0)
    records = F.coalesce(V.elements(value), F.when((F.size("_lists") == 1) & counted, V.elements(single)))
    read = read.withColumn("_records", records)

    def fields(record: Column) -> Column:
        places = F.filter(_texts(record, RECORD_PLACES), lambda p: F.length(p) <= MOST_PLACE)
        parts = F.nullif(F.array_join(_texts(record, RECORD_PLACE_PARTS), ", "), F.lit(""))
        key = F.coalesce(V.plain(V.member(record, "id")), V.plain(V.member(record, "ID")))
        return F.struct(_texts(record, ("title", "Title")).alias("titles"), _texts(record, RECORD_URLS).alias("urls"), F.when(key.rlike(r"^[A-Za-z0-9_-]{1,128}$"), key).alias("key"), F.coalesce(F.get(places, F.lit(0)), parts).alias("location"))

    def named(r: Column) -> Column:
        title = F.when((F.size(r["titles"]) == 1) & (F.length(F.get(r["titles"], F.lit(0))) <= MOST_TITLE), F.get(r["titles"], F.lit(0)))
        slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
        made = F.replace(F.replace("_template", F.lit("{id}"), r["key"]), F.lit("{slug}"), slug)
        url = F.when(F.size(r["urls"]) == 1, F.get(r["urls"], F.lit(0))).when((F.size(r["urls"]) == 0) & ~made.rlike("[{}]"), made)
        return F.struct(title.alias("title"), url.alias("url"), r["location"].alias("location"))

    resolved = lambda r: F.struct(r["title"], safe_normalize_url(r["url"], F.col("_endpoint")).alias("url"), r["location"])
    for step in (fields, named, resolved):
        read = read.withColumn("_records", F.transform("_records", step))
    # sorted by url, a record is the first of its url where the one before it has another
    read = read.withColumn("_sorted", F.sort_array(F.transform("_records", lambda r, i: F.struct(F.regexp_replace(r["url"], "/+$", "").alias("key"), i.alias("i"), r.alias("record")))))
    firsts = F.filter("_sorted", lambda x, k: (k == 0) | (F.get("_sorted", k - 1)["key"] != x["key"]))
    read = read.withColumn("_firsts", F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"], x["record"]))))
    sound = F.coalesce(F.forall("_records", lambda r: r["title"].isNotNull() & r["url"].isNotNull()), F.lit(False))
    once = F.transform("_firsts", lambda x: x["record"])
    full = F.coalesce(F.when(F.col("total").isNull(), F.col("_hint")).otherwise(F.col("total") == F.size("_records")), F.lit(False))
    none = F.array().cast("array<struct<title: string, url: string, location: string>>")
    return read.select(*payloads.columns, F.when(sound, once).otherwise(none).alias("rows"), F.when(sound, F.col("total")).alias("total"), (sound & full).alias("complete"))
