"""Rows that captured pages hold: links in groups of priority, cards by grammars, listing cards, postings in scripts, forms, routes and addresses.

Pages are read by table functions joined laterally, one pass a page, and everything behind that is expressions.  A page's rows stay small, and are put in order
or deduplicated within the page.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, scripts
from ..functions import structured as X
from ..functions import variants as V
from ..functions.scores import BOARD_DOMAINS
from ..functions.urls import authority_of, host_of, path_of, query_params, safe_normalize_url, same_site, scheme_of
from .shared import exploded

MOST_LINKS = 200
# A page yields so many listings and so many cards at most.
MOST_LISTINGS, MOST_CARDS = 1000, 500
# Grammars of known card tables.
GRAMMARS = {
    "job_search_cards": {
        "card": {"tag": "div", "class": "job-search-card"},
        "fields": {
            "job_id": {"tag": "div", "class": "job-search-card", "attribute": "data-entity-urn", "pattern": r"([^:]*)$"}, "job_title": {"tag": "h3", "class": "base-search-card__title"},
            "company_name": {"tag": "a", "class": "hidden-nested-link"}, "company_url": {"tag": "a", "class": "hidden-nested-link", "attribute": "href"},
            "location": {"tag": "span", "class": "job-search-card__location"}, "url": {"tag": "a", "class": "base-card__full-link", "attribute": "href"},
        },
    },
    "list_results": {"card": {"tag": "li", "class": "b_algo"}, "fields": {"url": {"tag": "a", "attribute": "href", "pattern": r"^(https?://.*)$"}, "title": {"tag": "a"}, "snippet": {"tag": "p"}}},
    "link_results": {"card": {"tag": "div", "class": "result"}, "fields": {"url": {"tag": "a", "class": "result__a", "attribute": "href"}, "title": {"tag": "a", "class": "result__a"}, "snippet": {"tag": "a|div", "class": "result__snippet"}}},
}
REQUIRED = {"job_search_cards": ("job_id", "job_title", "company_name", "url"), "list_results": ("url", "title"), "link_results": ("url", "title")}
# Words of a link's label, of a posting's path and of its query; labels and titles that name none.
CAREER_LABELS = ("career", "careers")
LIST_COMMANDS = ("view all jobs", "view jobs", "see all jobs", "search jobs", "all jobs", "open positions", "open roles", "current openings", "job openings", "browse jobs", "explore jobs", "view openings")
DETAIL_WORDS = ("apply", "application", "career", "careers", "detail", "details", "job", "jobs", "opening", "openings", "position", "positions", "role", "roles")
DETAIL_KEYS = ("id", "jid", "job_id", "jobid", "jobreqid", "reqid", "requisitionid")
TITLE_STOP_WORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "remote", "the", "to")
ACTION_LABEL = r"^(apply( now)?|details?|learn more|read more|see (role|job|details?)|view (role|job|details?)|more)$"
GENERIC_TITLE = r"^(careers?|jobs?|job openings?|open (roles?|positions?)|all (roles?|jobs?)|current openings?|search jobs?|engineering roles?)$"
NO_PLACE = r"([$£€¥]|\b(salary|compensation|per (hour|year)|full[- ]?time|part[- ]?time|posted|days? ago|hours? ago)\b)"
# A posting's fields.
TITLE_FIELDS = ("title", "name", "jobTitle", "job_title", "positionTitle")
URL_FIELDS = ("url", "absolute_url", "absoluteUrl", "hostedUrl", "applyUrl", "jobUrl", "job_url", "externalPath", "externalUrl", "detailUrl", "detail_url", "canonicalUrl", "link", "wdUrl")
PLACE_FIELDS = ("metro", "locationName", "jobLocation", "job_location", "location", "Location", "locations")


def _joined(pages: DataFrame, call, html: str) -> DataFrame:
    return pages.lateralJoin(call(F.col(html).outer()))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(_words(text), F.array(*map(F.lit, words)))


def is_board_url(url: Column) -> Column:
    """On a known board's domain or below it, without user and with a common port."""
    host = host_of(url)
    below = reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in BOARD_DOMAINS])
    return below & ~authority_of(url).rlike(r"@|:(?!(80|443)?$)")


def embedded_urls(html: Column) -> Column:
    """The http(s) urls in a page's scripts, escaped slashes resolved, without trailing signs, in order."""
    bodies = F.array_join(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1)), "")
    slashed = F.replace(F.regexp_replace(bodies, r"\\u00(?:2f|2F)", "/"), F.lit("\\/"), F.lit("/"))
    found = F.regexp_extract_all(X.unescaped(slashed), F.lit(r"(https?://[A-Za-z0-9._~:/?#\[\]@!$&*+,;=%()-]+)"), F.lit(1))
    return F.transform(found, lambda u: safe_normalize_url(F.regexp_replace(u, r"""['"),.;]+$""", "")))


def template_boards(html: Column) -> Column:
    """The boards that a page's embedding scripts are set up for, by their token."""
    flat = F.replace(F.coalesce(html, F.lit("")), F.lit("\\/"), F.lit("/"))
    found = F.regexp_extract_all(flat, F.lit(r"(?i)boards\.greenhouse\.io/embed/job_board(?:/js)?\?(?:[^\"'\s]*&(?:amp;)?)?for=([A-Za-z0-9_-]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.concat(F.lit("https://boards.greenhouse.io/"), F.lower(t))))


def page_links(pages: DataFrame, page: str, url: str, html: str, most: int = MOST_LINKS) -> DataFrame:
    """page, rank, url, text, origin: a page's links by group, then in order, each url once; capped after grouping, as the reader's contract says.

    Groups: boards of embedding scripts, anchors to boards, urls of boards in scripts, anchors labelled as careers, anchors that ask
    for the list of jobs, all anchors, all urls in scripts.  A url without a text takes the first text of its later sights.
    """
    own = pages.select(page, F.col(url).alias("_url"), F.col(html).alias("_html"))
    found = _joined(own, markup.anchors, "_html")
    found = found.select(page, "position", safe_normalize_url(F.col("href"), F.col("_url")).alias("url"), "text", F.size(_words(F.col("text"))).alias("n"))
    command = reduce(lambda a, b: a | b, [F.lower("text").contains(c) for c in LIST_COMMANDS])
    kinds = [(1, is_board_url(F.col("url"))), (3, F.col("n").between(1, 5) & _any_word(F.col("text"), CAREER_LABELS)), (4, command), (5, F.lit(True))]
    first = F.get(F.filter(F.array(*[F.when(c, g) for g, c in kinds]), lambda g: g.isNotNull()), F.lit(0))
    anchored = found.select(page, F.struct(first.alias("group"), "position").alias("at"), "url", "text", F.lit("anchor").alias("origin"))
    listed = lambda array, origin: exploded(own.select(page, F.transform(array, lambda u, i: F.struct(i.cast("int").alias("position"), u.alias("url"))).alias("_all")), F.col("_all"), "x").select(page, "x.*", F.lit("").alias("text"), F.lit(origin).alias("origin"))
    scripted = listed(embedded_urls(F.col("_html")), "embedded_url").withColumn("group", F.when(is_board_url(F.col("url")), 2).otherwise(6))
    boards = listed(template_boards(F.col("_html")), "derived_provider_config").withColumn("group", F.lit(0))
    rest = scripted.unionByName(boards).select(page, F.struct("group", "position").alias("at"), "url", "text", "origin")
    every = anchored.unionByName(rest).where("url is not null")
    once = every.groupBy(page, "url").agg(F.min(F.struct("at", "origin")).alias("first"), F.min(F.when(F.trim("text") != "", F.struct("at", "text"))).alias("named"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy("first.at", "url")))
    return ranked.where(F.col("rank") <= most).select(page, "rank", "url", F.coalesce("named.text", F.lit("")).alias("text"), "first.origin")


def table_cards(pages: DataFrame, html: str, grammar: str) -> DataFrame:
    """The pages' columns but the html, position and the fields of each card of a known grammar that has the required ones."""
    rule = GRAMMARS[grammar]
    rows = pages.lateralJoin(markup.cards(F.col(html).outer(), F.lit(json.dumps(rule))))
    needed = reduce(lambda a, b: a & b, [F.col("fields")[f].isNotNull() for f in REQUIRED[grammar]])
    return rows.where(needed).select(*[c for c in pages.columns if c != html], "position", *[F.col("fields")[f].alias(f) for f in rule["fields"]])


def _titled(title: Column, url: Column) -> Column:
    """Whether the url's path and query share a word with the title, stop words aside."""
    named = F.array_except(_words(title), F.array(*map(F.lit, TITLE_STOP_WORDS)))
    return F.arrays_overlap(named, _words(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", "")))


def _detail(url: Column, page: Column) -> Column:
    """A url of the page's own origin, or on a board, whose path or query names one posting."""
    keys = F.transform(query_params(url), lambda p: F.lower(F.substring_index(p, "=", 1)))
    deep = F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != "")) >= 2
    own = (scheme_of(url) == scheme_of(page)) & (host_of(url) == host_of(page)) & ~authority_of(url).rlike(r"[@:]")
    named = deep & _any_word(path_of(url), DETAIL_WORDS) | F.arrays_overlap(keys, F.array(*map(F.lit, DETAIL_KEYS)))
    return (own | is_board_url(url)) & named


def card_listings(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """page, position, title, url, location of the listing cards that hold exactly one plausible title and one posting's url that shares a word with it.

    Without a title node the text of the link is the title; a place counts where a card has one only.
    """
    own = pages.select(page, F.col(url).alias("_url"), F.col(html).alias("_html"))
    rows = _joined(own, markup.listing_cards, "_html").drop("_html")
    plausible = lambda t: F.length(t).between(2, 200) & t.rlike("[A-Za-z]") & ~F.lower(t).rlike(ACTION_LABEL) & ~F.lower(t).rlike(GENERIC_TITLE)
    rows = rows.withColumn("titles", F.filter("titles", plausible))
    rows = rows.withColumn("links", F.transform("links", lambda x: F.struct(safe_normalize_url(x["href"], F.col("_url")).alias("url"), x["text"])))
    rows = rows.withColumn("links", F.filter("links", lambda x: F.coalesce(_detail(x["url"], F.col("_url")), F.lit(False))))
    rows = rows.withColumn("urls", F.array_distinct(F.transform("links", lambda x: x["url"])))
    rows = rows.withColumn("titles", F.when(F.size("titles") > 0, F.col("titles")).otherwise(F.array_distinct(F.filter(F.transform("links", lambda x: x["text"]), plausible))))
    rows = rows.withColumn("places", F.filter("places", lambda p: F.length(p).between(1, 160) & p.rlike("[A-Za-z]") & ~F.lower(p).rlike(NO_PLACE)))
    one = rows.where((F.size("titles") == 1) & (F.size("urls") == 1)).select(page, "position", F.get("titles", F.lit(0)).alias("title"), F.get("urls", F.lit(0)).alias("url"), F.when(F.size("places") == 1, F.get("places", F.lit(0))).alias("location"))
    first = Window.partitionBy(page, F.regexp_replace("url", "/+$", ""), F.lower("title")).orderBy("position")
    kept = one.where(_titled(F.col("title"), F.col("url"))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("position"))).where(F.col("_n") <= MOST_CARDS).drop("_n")


def script_values(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """page, page_url, position, script, name and value (VARIANT) of everything that the pages' scripts state literally."""
    own = pages.select(page, F.col(url).alias("page_url"), F.col(html).alias("_html"))
    return _joined(own, scripts.script_values, "_html").select(page, "page_url", "position", "script", "name", F.try_parse_json("value").alias("value"))


def stated_postings(values: DataFrame, page: str) -> DataFrame:
    """page, position, nth, title, url, location of the records among script values that have a title and a sound url (``script_values``)."""
    records = V.job_records(F.col("value"))
    rows = values.select(page, "page_url", "position", F.posexplode_outer(records).alias("nth", "record")).where("record is not null")
    place = F.coalesce(*[X.location_text(V.raw(V.member(F.col("record"), f))) for f in PLACE_FIELDS])
    rows = rows.select(page, "page_url", "position", "nth", V.first_text(F.col("record"), TITLE_FIELDS).alias("title"), V.first_text(F.col("record"), URL_FIELDS).alias("_raw"), place.alias("location"))
    sound = F.filter(F.array(F.struct(safe_normalize_url(F.col("_raw"), F.col("page_url")).alias("url"))), lambda r: r["url"].isNotNull() & F.col("title").isNotNull())
    return exploded(rows, sound, "_found").select(page, "position", "nth", "title", "_found.url", "location")


def listings(pages: DataFrame, page: str, url: str, html: str, most: int = MOST_LISTINGS) -> DataFrame:
    """page, rank, title, url, location, origin of a page's postings: of its cards, then of its scripts, each url and title once."""
    cards = card_listings(pages, page, url, html).select(page, F.struct(F.lit(0).alias("source"), "position", F.lit(0).alias("nth")).alias("at"), "title", "url", "location", F.lit("card").alias("origin"))
    stated = stated_postings(script_values(pages, page, url, html), page).select(page, F.struct(F.lit(1).alias("source"), "position", "nth").alias("at"), "title", "url", "location", F.lit("structured_state").alias("origin"))
    key = [F.col(page), F.regexp_replace("url", "/+$", ""), F.lower(F.trim("title"))]
    first = cards.unionByName(stated).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).where("_n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy("at", "url", "title")))
    return ranked.where(F.col("rank") <= most).select(page, "rank", "title", "url", "location", "origin")


def stated_addresses(values: DataFrame, page: str) -> DataFrame:
    """page, position, name and url of the page's own addresses that scripts fetch or hold and whose words speak of postings."""
    text = F.when(F.schema_of_variant("value") == "STRING", V.plain(F.col("value")))
    rows = values.select(page, "position", "name", "page_url", text.alias("_raw")).withColumn("url", safe_normalize_url(F.col("_raw"), F.col("page_url")))
    spoken = _any_word(F.regexp_replace("url", r"^[a-z]+://[^/?#]*", ""), (*DETAIL_WORDS, "vacancies", "vacancy", "requisitions", "postings"))
    return rows.where("_raw is not null").where(F.coalesce(same_site(F.col("url"), F.col("page_url")) & spoken, F.lit(False))).select(page, "position", "name", "url")


def stated_routes(values: DataFrame, page: str) -> DataFrame:
    """page, position, nth, path and label of objects among script values that pair a route with a label."""
    rows = values.select(page, "position", F.posexplode_outer(F.transform(V.objects(F.col("value")), lambda n: n["value"])).alias("nth", "record")).where("record is not null")
    path, label = V.first_text(F.col("record"), ("path", "route", "to", "href")), V.first_text(F.col("record"), ("label", "title", "text", "name"))
    pair = F.filter(F.array(F.struct(path.alias("path"), label.alias("label"))), lambda r: r["path"].startswith("/") & r["label"].isNotNull())
    return exploded(rows, pair, "pair").select(page, "position", "nth", "pair.*")


def search_forms(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """page, position, action, method, query and fixed of the same site's forms that search: ``query`` is the field to fill, ``fixed`` the hidden ones."""
    own = pages.select(page, F.col(url).alias("_url"), F.col(html).alias("_html"))
    rows = _joined(own, markup.forms, "_html")
    free = F.filter("inputs", lambda i: i["type"].isin("text", "search"))
    rows = rows.withColumns({"action": safe_normalize_url(F.coalesce(F.nullif(F.col("action"), F.lit("")), F.col("_url")), F.col("_url")), "query": F.get(F.transform(free, lambda i: i["name"]), F.lit(0))})
    fixed = F.transform(F.filter("inputs", lambda i: i["type"] == "hidden"), lambda i: F.concat(i["name"], F.lit("="), F.coalesce(i["value"], F.lit(""))))
    fits = F.col("query").isNotNull() & F.col("method").isin("get", "post") & same_site(F.col("action"), F.col("_url"))
    return rows.where(F.coalesce(fits, F.lit(False))).select(page, "position", "action", "method", "query", fixed.alias("fixed"))


def page_evidence(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, position, kind, text and source (the text as it is written) of a page's visible headings and places."""
    return _joined(pages.select(page, F.col(html).alias("_html")), markup.evidence, "_html").drop("_html")
