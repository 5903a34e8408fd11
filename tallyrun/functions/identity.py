"""Identities of results, postings, companies and boards as column expressions, and the gates that compare them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import provider_of
from .text import words
from .urls import canonical_url, host_of, path_of, path_segments, tenant_locator, urls_equivalent

# Words that carry no identity, places that titles abbreviate, and what stands for a region in paths.
ENTITY_STOPWORDS = ("co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc", "the")
QUERY_STOPWORDS = ("and", "co", "company", "corp", "corporation", "inc", "llc", "ltd", "the")
TITLE_PLACES = {"nyc": "New York, NY", "new york city": "New York, NY", "dc": "Washington, DC", "d c": "Washington, DC", "washington dc": "Washington, DC"}
REGION_PATHS = {"us": ("us", "usa", "united-states", "unitedstates", "en-us", "en_us")}


def public_identity(website: Column, career: Column, board: Column, opening: Column, provider: Column) -> Column:
    """struct(website_url, career_page_url, job_board, opening) of canonical urls."""
    listing = canonical_url(board)
    return F.struct(
        canonical_url(website).alias("website_url"), canonical_url(career).alias("career_page_url"),
        F.struct(provider.alias("provider"), tenant_locator(board).alias("tenant"), listing.alias("canonical_url")).alias("job_board"), F.struct(canonical_url(opening).alias("canonical_url")).alias("opening"),
    )


def canonical_posting_url(url: Column) -> Column:
    """The posting's page on the network's own host over https, without query and fragment; null for anything else."""
    key = F.regexp_extract(F.trim(url), r"^(?i:https)://(?i:(?:www\.)?linkedin\.com)\.?(?::(?:443)?)?/jobs/view/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(key != "", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), key))


def title_location(title: Column) -> Column:
    """The place that a title's qualifier (after a comma or dash, or in brackets) abbreviates, else null."""
    found = F.regexp_extract_all(title, F.lit(r"(?:,|\s+-\s+|\()\s*([^,()]{1,80})\)?(?:\s*$|,)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in TITLE_PLACES.items() for x in kv])
    places = F.transform(found, lambda q: F.try_element_at(table, F.array_join(words(q), " ")))
    return F.get(F.filter(places, lambda p: p.isNotNull()), F.lit(0))


def career_keyword(url: Column, text: Column, keyword: str) -> Column:
    """One word among the text's, host's and path's, or several in a row in the text or the path; ``career`` also finds ``careers``."""
    tokens = keyword.lower().replace("-", " ").split()
    segments = F.transform(path_segments(url), lambda s: F.array_join(words(s), " "))
    kept = F.filter(segments, lambda s: (s != "jobs to be done") & ~s.startswith("jobsite") & (s != ""))
    path = F.split(F.array_join(kept, " "), " ")
    if not tokens:
        return F.lit(False)
    if len(tokens) == 1:
        seen = F.concat(words(text), F.split(host_of(url), r"\."), path)
        return F.array_contains(seen, tokens[0]) | (F.lit(tokens[0] == "career") & F.array_contains(seen, "careers"))
    phrase = " ".join(tokens)
    return F.array_join(words(text), " ").contains(phrase) | F.array_join(path, " ").contains(phrase)


def search_queries(company: Column, domain: Column) -> Column:
    """The distinct queries for a company's career pages, in order; those of its site only where a domain is known."""
    site = F.when(F.coalesce(domain, F.lit("")) != "", F.array(F.concat(F.lit("site:"), domain, F.lit(" careers")), F.concat(F.lit("site:"), domain, F.lit(" jobs")))).otherwise(F.array().cast("array<string>"))
    own = lambda suffix: F.concat(company, F.lit(suffix))
    return F.array_distinct(F.concat(F.array(own(" careers jobs")), site, F.array(own(" careers"), own(" jobs"))))


def company_words(name: Column) -> Column:
    return F.array_join(words(name), " ")


def identity_tokens(company: Column, domain: Column) -> Column:
    """Distinct words of three letters or more of the name and the domain's first label, without stopwords."""
    label = F.regexp_replace(F.lower(F.substring_index(F.coalesce(domain, F.lit("")), ".", 1)), r"^www\.", "")
    return F.array_distinct(F.filter(F.concat(F.filter(words(company), lambda w: ~w.isin(*QUERY_STOPWORDS)), F.array(label)), lambda w: F.length(w) >= 3))


def strict_entity_key(name: Column) -> Column:
    return F.array_join(F.filter(words(name), lambda w: ~w.isin(*ENTITY_STOPWORDS)), "")


def sitemap_priority(url: Column, region: str | None) -> Column:
    """struct(region_rank, inventory_rank): 0 where the path names the region, and where it says ``job``; else 1."""
    path = F.lower(path_of(url))
    names = REGION_PATHS.get(region.lower(), (region.lower(),)) if region else ()
    here = reduce(lambda a, b: a | b, [path.rlike(rf"(^|[._/-])\Q{n}\E([._/-]|$)") for n in names], F.lit(False))
    return F.struct(F.when(here, 0).otherwise(1).alias("region_rank"), F.when(path.contains("job"), 0).otherwise(1).alias("inventory_rank"))


def board_matches(provider: Column, tenant: Column, url: Column, target: Mapping[str, Column]) -> Column:
    """The same provider and tenant, and equivalent board urls."""
    return F.coalesce((provider == target["provider"]) & (tenant == target["tenant"]) & urls_equivalent(url, target["url"]), F.lit(False))


def durable_outcome(opening: Column, no_match: Column, blocked: Column, verified: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(opening, F.lit("")) != "", "exact").when(yes(no_match), "verified_no_match").when(yes(blocked) & yes(verified), "external_blocked").otherwise("unresolved")


def outcomes_match(required: Mapping[str, tuple[Column, Column]], declared: Mapping[str, tuple[Column, Column]]) -> Column:
    """All required (expected, actual) pairs are equal, nulls included, and those of ``declared`` whose expected value is given."""
    tests = [e.eqNullSafe(a) for e, a in required.values()] + [e.isNull() | e.eqNullSafe(a) for e, a in declared.values()]
    return reduce(lambda a, b: a & b, tests)


def route_failures(route: Mapping[str, Column], provider: Mapping[str, Column], opening: Mapping[str, Column]) -> Column:
    """Failure codes of an opening's route between a source board and a target board, in fixed order; none where there is no route.

    ``route`` has present, verified, provider, source_tenant, source_board, target_tenant, target_board and url; the others provider, tenant,
    board, and ``opening`` also url.
    """
    other = lambda *pairs: reduce(lambda a, b: a | b, [~x.eqNullSafe(y) for x, y in pairs])
    rules = [
        ("OPENING_ROUTE_EVIDENCE_UNVERIFIED", ~F.coalesce(route["verified"], F.lit(False))),
        ("OPENING_ROUTE_SOURCE_MISMATCH", other((route["provider"], provider["provider"]), (route["source_tenant"], provider["tenant"]), (route["source_board"], provider["board"]))),
        ("OPENING_ROUTE_TARGET_MISMATCH", other((route["provider"], opening["provider"]), (route["target_tenant"], opening["tenant"]), (route["target_board"], opening["board"]))),
        ("OPENING_ROUTE_URL_MISMATCH", other((route["url"], opening["url"]))),
    ]
    codes = F.filter(F.array(*[F.when(t, c) for c, t in rules]), lambda x: x.isNotNull())
    return F.when(F.coalesce(route["present"], F.lit(False)), codes).otherwise(F.array().cast("array<string>"))


def combined_failures(*codes: Column) -> Column:
    """All codes once, in order of first sight."""
    return F.array_distinct(F.concat(*codes))


def direct_candidate(url: Column, kind: str, hosted_only: bool) -> Column:
    """struct(url, kind, provider) of a declared url; null without one, or without a known provider where one is asked for."""
    target, provider = canonical_url(url), provider_of(url)
    sound = target.isNotNull() & (provider.isNotNull() if hosted_only else F.lit(True))
    return F.when(sound, F.struct(target.alias("url"), F.lit(kind).alias("kind"), provider.alias("provider")))
