"""Structured data in captured pages as column expressions: JSON-LD, locations, canonical and alternate links, redirects, search feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import safe_normalize_url
from .variants import objects

MOST_LOCATIONS = 25
"""A longer list of places names none, as the contract says."""
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """The five entities of XML as characters."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _ENTITIES, text)


def json_ld_scripts(html: Column) -> Column:
    """The bodies of all JSON-LD scripts, in order."""
    pattern = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1)), lambda s: unescaped(F.trim(s)))


def _items(raw: Column) -> Column:
    """A JSON array's elements, or the value alone, as JSON texts; none for null."""
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(F.ltrim(raw).startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(raw))


def json_ld_nodes(html: Column) -> Column:
    """All objects of a page's JSON-LD at any depth down to the bound, graphs and lists included, as JSON texts in the order of a walk."""
    return F.flatten(F.transform(json_ld_scripts(html), lambda s: F.transform(objects(F.try_parse_json(s)), lambda n: F.to_json(n["value"]))))


def of_type(nodes: Column, kind: str) -> Column:
    """The nodes whose ``@type`` is or holds ``kind``, in any case."""
    types = lambda n: _items(F.lower(F.get_json_object(n, "$['@type']")))
    return F.filter(nodes, lambda n: F.array_contains(types(n), kind.lower()))


def _text(raw: Column, *paths: str) -> Column:
    """The first of the paths with text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$.{p}")), F.lit("")) for p in paths])


def _place(raw: Column) -> Column:
    combined = F.nullif(F.concat_ws(", ", _text(raw, "address.addressLocality", "address.city"), _text(raw, "address.addressRegion", "address.state")), F.lit(""))
    is_object = F.ltrim(raw).startswith("{")
    plain = F.nullif(F.trim(raw), F.lit(""))
    reference = plain.rlike(r"(?i)^\$[a-z0-9]+(:[a-z0-9_]+)+$")
    return F.when(is_object, F.coalesce(combined, _text(raw, "city", "locationName", "name", "formattedAddress", "country"))).when(~reference, plain)


def location_text(raw: Column) -> Column:
    """A place as text from a JSON value: text as it stands, an object's locality and region or name, distinct ones of a list joined by ``; ``."""
    items = _items(raw)
    places = F.array_distinct(F.filter(F.transform(items, _place), lambda p: p.isNotNull()))
    return F.when(F.size(items) <= MOST_LOCATIONS, F.nullif(F.array_join(places, "; "), F.lit("")))


def job_postings(html: Column, page_url: Column) -> Column:
    """array(struct(url, title, location, organization)) of a page's JSON-LD job postings that have a title and a sound url (else the page's)."""
    rows = F.transform(of_type(json_ld_nodes(html), "JobPosting"), lambda n: F.struct(
        safe_normalize_url(F.coalesce(_text(n, "url"), page_url)).alias("url"), _text(n, "title", "name").alias("title"),
        location_text(F.get_json_object(n, "$.jobLocation")).alias("location"), _text(n, "hiringOrganization.name").alias("organization"),
    ))
    return F.filter(rows, lambda r: r["title"].isNotNull() & r["url"].isNotNull())


def organization_websites(html: Column) -> Column:
    """The distinct sound urls of a page's JSON-LD organizations (``url``, else ``sameAs``), in order."""
    sites = F.transform(of_type(json_ld_nodes(html), "Organization"), lambda n: safe_normalize_url(F.coalesce(_text(n, "url"), _text(n, "sameAs[0]"), _text(n, "sameAs"))))
    return F.array_distinct(F.filter(sites, lambda u: u.isNotNull()))


def organization_names(html: Column) -> Column:
    """Names and legal names of a page's JSON-LD organizations, in order."""
    names = F.transform(of_type(json_ld_nodes(html), "Organization"), lambda n: F.array(_text(n, "name"), _text(n, "legalName")))
    return F.filter(F.flatten(names), lambda n: n.isNotNull())


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in any quotes or none; null where the tag has it not exactly once."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract_all(tag, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) == 1, unescaped(F.regexp_replace(F.get(found, F.lit(0)), r"""^["']|["']$""", "")))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"""(?is)<{name}\b(?:"[^"]*"|'[^']*'|[^>"'])*>"""), F.lit(0))


def canonical_link(html: Column) -> Column:
    """The href of the first ``<link rel=canonical>``."""
    links = F.filter(_tags(html, "link"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    return attribute(F.get(links, F.lit(0)), "href")


def alternate_links(html: Column, language: str = "en-us", most: int = 10) -> Column:
    """The hrefs of ``<link rel=alternate>`` for a language."""
    fits = lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "alternate") & (F.lower(F.trim(attribute(t, "hreflang"))) == language) & (F.trim(attribute(t, "href")) != "")
    return F.slice(F.transform(F.filter(_tags(html, "link"), lambda t: F.coalesce(fits(t), F.lit(False))), lambda t: attribute(t, "href")), 1, most)


def redirect_target(html: Column) -> Column:
    """Where a page sends its reader: the url of a meta refresh, else of an assignment to ``location`` in a script; else null."""
    refresh = F.filter(_tags(html, "meta"), lambda t: F.coalesce(F.lower(attribute(t, "http-equiv")) == "refresh", F.lit(False)))
    meta = F.regexp_extract(attribute(F.get(refresh, F.lit(0)), "content"), r"""(?i)url\s*=\s*['"]?([^'"\s]+)""", 1)
    script = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<script\b[^>]*>[^<]*\blocation(?:\.href)?\s*=\s*["']([^"']+)["']""", 1)
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(script, F.lit("")))


def data_urls(html: Column) -> Column:
    """The distinct http(s) urls in JSON that ``data-`` attributes hold, in order."""
    values = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)\sdata-[a-z0-9-]+\s*=\s*('[\[{][^']*'|"[\[{][^"]*")"""), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.transform(F.regexp_extract_all(unescaped(v), F.lit(r'"(https?:\\?/\\?/[^"\s]+)"'), F.lit(1)), lambda u: F.replace(u, F.lit("\\/"), F.lit("/"))))))


def feed_items(body: Column) -> Column:
    """array(struct(url, title, snippet)) of an RSS feed's items that have a link."""
    part = lambda item, tag: F.trim(unescaped(F.regexp_replace(F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")))
    items = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    return F.filter(F.transform(items, lambda i: F.struct(part(i, "link").alias("url"), part(i, "title").alias("title"), part(i, "description").alias("snippet"))), lambda r: r["url"] != "")


def search_hits(body: Column) -> Column:
    """array(struct(url, title, snippet)) of a search result's JSON ``results`` that have a url; absent texts are empty."""
    hits = _items(F.get_json_object(body, "$.results"))
    rows = F.transform(hits, lambda h: F.struct(F.get_json_object(h, "$.url").alias("url"), F.coalesce(F.get_json_object(h, "$.title"), F.lit("")).alias("title"), F.coalesce(F.get_json_object(h, "$.content"), F.lit("")).alias("snippet")))
    return F.filter(rows, lambda r: F.coalesce(F.trim(r["url"]) != "", F.lit(False)))
