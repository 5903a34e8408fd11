"""Additive scores of links and candidate sites, with the reasons that made them, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import company_tokens, contains_phrase, words
from .urls import host_in, host_of, path_depth, path_of, path_segments, query_params

# Weights of words that a career link or a job link shows, and of words that speak against one.
CAREER_WORDS = {
    "careers": 100, "career": 95, "jobs": 95, "join-us": 85, "join us": 85, "work-with-us": 75, "work with us": 75, "open roles": 70,
    "open positions": 70, "opportunities": 55, "hiring": 45, "recruiting": 35, "vacancies": 35, "employment": 55,
}
JOB_WORDS = {
    "engineer": 35, "developer": 35, "scientist": 35, "designer": 30, "manager": 30, "analyst": 30, "intern": 40, "software": 30,
    "machine learning": 45, "data": 20, "product": 20, "marketing": 18, "nurse": 35, "sales": 18, "operations": 18, "research": 18,
}
NEGATIVE_WORDS = {
    "privacy": -100, "terms": -100, "cookie": -100, "press": -45, "news": -45, "magazine": -180, "about": -35, "contact": -35,
    "benefits": -120, "culture": -55, "life at": -55, "office": -35, "locations": -60, "department": -55, "all jobs": -35, "all roles": -35,
    "article": -80, "blog": -80, "insight": -80, "insights": -80, "resource": -55, "resources": -55, "how-": -100, "why-": -100, "what-": -100,
    "guide": -55, "whitepaper": -80,
}
RESOURCE_EXTENSIONS = ("apng", "avif", "css", "gif", "ico", "jpeg", "jpg", "js", "json", "map", "mjs", "pdf", "png", "svg", "txt", "webp", "woff", "woff2", "xml")
NON_OFFICIAL_DOMAINS = ("linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com")
LISTING_PARTS = ("jobs", "job", "careers", "career", "positions", "openings", "job-openings", "job-offers", "our-job-offers", "job-results", "joblisting", "search-results", "candidateexperience")
DETAIL_KEYS = ("id", "jid", "jobid", "job_id", "jobreqid", "reqid", "requisitionid")
SOURCE_PRIORITIES = {
    "external_apply": 500, "first_party_ats_link": 400, "stored_verified_provider_board": 350, "stored_verified_career_provider": 325,
    "targeted_opening_search": 300, "verified_tenant_probe": 250, "targeted_board_search": 200, "guessed_path": 100,
}
# Hosted boards by domain; the most specific domain decides.
BOARD_DOMAINS = {
    "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "jobs.ashbyhq.com": "ashby", "ashbyhq.com": "ashby",
    "apply.workable.com": "workable", "workable.com": "workable", "jobs.smartrecruiters.com": "smartrecruiters", "smartrecruiters.com": "smartrecruiters",
    "recruitee.com": "recruitee", "bamboohr.com": "bamboohr", "jobvite.com": "jobvite", "icims.com": "icims", "successfactors.com": "successfactors",
    "successfactors.eu": "successfactors", "sapsf.com": "successfactors", "sapsf.eu": "successfactors", "myworkdayjobs.com": "workday", "ats.rippling.com": "rippling",
    "eightfold.ai": "eightfold", "careers.oracle.com": "oracle_hcm", "oraclecloud.com": "oracle_hcm", "pinpointhq.com": "pinpoint", "recruiting.adp.com": "adp",
    "workforcenow.adp.com": "adp", "hcshiring.com": "healthcaresource", "ultipro.com": "ultipro", "recruiting.paylocity.com": "paylocity",
    "recruitingbypaycor.com": "paycor", "applytojob.com": "jazzhr", "applicantstack.com": "applicantstack", "whitecarrot.io": "whitecarrot", "whitecarrot.ai": "whitecarrot",
}


def provider_of(url: Column, domains: dict[str, str] = BOARD_DOMAINS) -> Column:
    """The provider of the longest domain that the host equals or is below; null for others."""
    ordered = sorted(domains.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return reduce(lambda acc, kv: acc.when(host_in(url, [kv[0]]), kv[1]), ordered, F.when(F.lit(False), ""))


def is_board(url: Column) -> Column:
    return host_in(url, list(BOARD_DOMAINS))


def is_resource(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(r"\.(" + "|".join(RESOURCE_EXTENSIONS) + ")$")


def scored(rules: list[tuple[str, Column, int | Column]]) -> Column:
    """struct(score, reasons): the sum of the points of all rules that hold, and their names in order."""
    points = [(name, F.coalesce(test, F.lit(False)), F.lit(p) if isinstance(p, int) else p) for name, test, p in rules]
    total = reduce(lambda a, b: a + b, [F.when(test, p).otherwise(0) for _, test, p in points], F.lit(0))
    reasons = F.filter(F.array(*[F.when(test, name) for name, test, _ in points]), lambda x: x.isNotNull())
    return F.struct(total.cast("int").alias("score"), reasons.alias("reasons"))


def floored(found: Column, test: Column, points: int) -> Column:
    """A struct of ``scored`` with the score no lower than ``points`` where the test holds."""
    return F.struct(F.when(test, F.greatest(found["score"], F.lit(points))).otherwise(found["score"]).alias("score"), found["reasons"].alias("reasons"))


def _instead(test: Column, name: str, points: int, otherwise: Column) -> Column:
    fixed = F.struct(F.lit(points).alias("score"), F.array(F.lit(name)).alias("reasons"))
    return F.when(F.coalesce(test, F.lit(False)), fixed).otherwise(otherwise)


def career_link_score(url: Column, text: Column) -> Column:
    """How likely a link leads to a career page."""
    label = F.lower(F.concat_ws(" ", host_of(url), path_of(url), text))
    haystack = F.lower(F.concat_ws(" ", path_of(url), text, host_of(url)))
    rules = [(f"word:{w}", contains_phrase(label, F.lit(w)), p) for w, p in CAREER_WORDS.items()]
    rules += [("board", is_board(url), 95), ("board_root", is_board(url) & (path_depth(url) <= 1), 25)]
    rules += [(f"against:{w}", haystack.contains(w), p) for w, p in NEGATIVE_WORDS.items()]
    return _instead(is_resource(url), "resource", -500, scored(rules))


def job_link_score(url: Column, text: Column, page_url: Column) -> Column:
    """How likely a link leads to a job or a list of jobs."""
    path, leaf = F.lower(path_of(url)), F.lower(F.element_at(path_segments(url), -1))
    keys = F.transform(query_params(url), lambda p: F.lower(F.substring_index(p, "=", 1)))
    numeric = path.rlike(r"/(jobs?|positions?|openings?|careers?)/([^/]*[-/])?\d{3,}")
    query = F.arrays_overlap(keys, F.array(*map(F.lit, DETAIL_KEYS)))
    title = contains_phrase(path, F.lit("careers")) & (F.size(words(text)) >= 2)
    kinds = [
        ("numeric_detail", numeric, 90), ("query_detail", query, 90), ("listing_leaf", leaf.isin(*LISTING_PARTS), 80),
        ("job_path", path.rlike("/(jobs?|positions?|openings?)/"), 60), ("career_title", title, 60), ("search_leaf", leaf.rlike("^search"), 25),
        ("all_jobs", F.lower(text).rlike(r"\b(all|view|see) (jobs|openings|roles)\b"), 20),
    ]
    taken, first = F.lit(False), []
    for name, test, p in kinds:
        test = F.coalesce(test, F.lit(False))
        first.append((name, test & ~taken, p))
        taken = taken | test
    command = F.lower(F.trim(text)).rlike(r"^(view|see|browse|search|explore|find)( all)?( our| open)? (jobs|openings|positions|roles|opportunities)$")
    haystack = F.lower(F.concat_ws(" ", path_of(url), text, host_of(url)))
    rules = [("same_page", url == page_url, -200), ("board", is_board(url), 75), ("board_detail", is_board(url) & (path_depth(url) >= 2), 120), ("board_list", is_board(url) & (path_depth(url) < 2), 25)]
    rules += [*first, ("command", command, 30)]
    rules += [(f"word:{w}", contains_phrase(text, F.lit(w)), p) for w, p in JOB_WORDS.items()]
    rules += [(f"against:{w}", haystack.contains(w), p) for w, p in NEGATIVE_WORDS.items()] + [("deep", path_depth(url) >= 2, 10)]
    found = floored(scored(rules), F.coalesce(command, F.lit(False)), 55)
    return _instead(is_resource(url) | host_in(url, NON_OFFICIAL_DOMAINS), "not_official", -500, found)


def website_score(domain: Column, company: Column, title: Column, body: Column) -> Column:
    """How likely a domain is the company's own: tokens in the domain and the page speak for it."""
    tokens, low = company_tokens(company), F.lower(domain)
    inside = F.size(F.filter(tokens, lambda t: low.contains(t)))
    head = words(F.substring(body, 1, 5000))
    seen = F.size(F.filter(tokens, lambda t: F.array_contains(head, t)))
    rules = [
        ("domain_tokens", inside > 0, 35 * inside), ("credible_suffix", low.rlike(r"\.(com|org|net|io|co|edu|gov)$"), 10), ("com", low.endswith(".com"), 8),
        ("title", contains_phrase(title, F.array_join(tokens, " ")), 25), ("body_tokens", seen > 0, 15 * seen), ("no_body_token", (seen == 0) & body.isNotNull(), -35),
        ("not_fetched", body.isNull(), -20), ("parked", is_parked(body), -200), ("hosted", host_in(F.concat(F.lit("https://"), domain), NON_OFFICIAL_DOMAINS), -200),
    ]
    return scored(rules)


def is_parked(text: Column) -> Column:
    return F.lower(text).rlike(r"(domain (name )?(is )?for sale|buy this domain|this domain (is|may be) (parked|for sale)|parked free|domain parking)")


def is_closed_posting(text: Column) -> Column:
    return F.lower(text).rlike(r"(no longer accepting applications|(job|position|posting|role) (has been|is|was) (closed|filled|expired)|this (job|position) is no longer available)")


def is_empty_listing(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(no|not any|0|zero) (current |open |available )*(jobs?|openings?|positions?|vacancies|opportunities)\b")


def evidence_tier(sources: Column) -> Column:
    """0 verified, 1 first-party, 2 searched, 3 guessed; the best of an array of sources, 4 where it is empty."""
    tiers = [(0, ("stored_verified_provider_board", "stored_verified_career_provider", "external_apply")), (1, ("first_party_ats_link",)), (2, ("targeted_opening_search", "targeted_board_search", "verified_tenant_probe")), (3, ("guessed_path",))]
    return reduce(lambda acc, kv: acc.when(F.arrays_overlap(sources, F.array(*map(F.lit, kv[1]))), kv[0]), tiers, F.when(F.lit(False), 0)).otherwise(4)


def source_priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def search_bonus(url: Column, official_domain: Column) -> Column:
    """60 for the official site, 40 for a hosted board, 20 for a career word in the path."""
    official = (host_of(url) == official_domain) | host_of(url).endswith(F.concat(F.lit("."), official_domain))
    return F.when(official, 60).otherwise(0) + F.when(is_board(url), 40).otherwise(0) + F.when(F.lower(path_of(url)).rlike("career|jobs"), 20).otherwise(0)


def label_class(text: Column) -> Column:
    """``command`` for a verb and a job object, ``object`` for an object alone, else null."""
    verb, obj = r"(view|see|browse|search|explore|find|apply|join)", r"(jobs?|openings?|positions?|roles?|careers?|opportunit(y|ies)|vacanc(y|ies))"
    low = F.lower(F.trim(text))
    return F.when(low.rlike(rf"^{verb}\b.*\b{obj}$"), "command").when(low.rlike(rf"^(all |open |our |current )*{obj}$"), "object")


def page_kind(url: Column) -> Column:
    """asset, detail, listing or other, the first that fits."""
    path, leaf = F.lower(path_of(url)), F.lower(F.element_at(path_segments(url), -1))
    keys = F.transform(query_params(url), lambda p: F.lower(F.substring_index(p, "=", 1)))
    detail = path.rlike(r"/(jobs?|positions?|openings?|careers?)/([^/]*[-/])?(\d{3,}|[0-9a-f]{8}-[0-9a-f]{4}-)") | F.arrays_overlap(keys, F.array(*map(F.lit, DETAIL_KEYS)))
    return F.when(is_resource(url), "asset").when(F.coalesce(detail, F.lit(False)), "detail").when(leaf.isin(*LISTING_PARTS), "listing").otherwise("other")
