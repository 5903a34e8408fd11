"""Queries over the scalar functions: inputs made from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import privacy, scores, text, urls
from ..operators import matching as M
from ..operators import summaries as S
from ..operators.shared import spread
from .tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", "html")


def fn02_url_equivalence(spark: SparkSession, d: str) -> DataFrame:
    p, url = _pages(spark, d), F.col("url")
    www = F.regexp_replace(url, "://", "://WWW.")
    upper = F.concat(F.upper(F.substring_index(url, "/", 3)), F.substring(url, F.length(F.substring_index(url, "/", 3)) + 1, 10_000))
    return p.select("page_id", urls.urls_equivalent(url, upper).alias("folded"), urls.urls_equivalent(url, www).alias("strict"), urls.urls_equivalent(url, www, True).alias("loose"), urls.tenant_locator(url).alias("tenant"))


def fn05_normalized(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    resolved = urls.resolve_url(F.concat(F.lit("../x/./y?z="), "page_id"), F.col("url"))
    return _pages(spark, d).select("page_id", urls.normalize_url(F.col("url")).alias("normal"), urls.normalize_url(bare).alias("bare"), urls.safe_normalize_url(F.concat(F.lit("mailto:"), "url")).alias("mail"), resolved.alias("resolved"))


def fn10_sanitized(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?token=a1&page=2&client_secret="), "page_id", F.lit("&API_KEY=q#frag"))
    identity = urls.request_identity(F.lit("post"), url, F.col("html"))
    return _pages(spark, d).select("page_id", urls.sanitize_url(url).alias("clean"), identity["method"].alias("method"), identity["body_fingerprint"].alias("body"))


def fn13_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    coded = F.regexp_replace(F.translate(F.base64(F.encode("url", "UTF-8")), "+/\r\n", "-_"), "=+$", "")
    plain = F.concat(F.lit("https://search.example/l/?kh=1&uddg="), F.url_encode("url"))
    other = F.concat(F.lit("https://search.example/ck?u=a1"), coded)
    return _pages(spark, d).select("page_id", urls.unwrap_redirect(plain).alias("plain"), urls.unwrap_redirect(other).alias("coded"), urls.unwrap_redirect(F.lit("https://search.example/?q=x")).alias("same"), urls.origin_of(F.col("url")).alias("origin"))


def fn15_url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    posting = F.concat(F.lit("https://de.linkedin.com/jobs/view/some-title-"), (F.col("page_id") + 1_000_000).cast("string"), F.when(F.col("page_id") % 2 == 0, "/").otherwise("?x=1"))
    more = urls.add_query_params(url, {"q": "a b", "n": F.col("page_id").cast("string")})
    return _pages(spark, d).select("page_id", urls.url_region(url).alias("region"), urls.posting_id(posting, "linkedin.com").alias("posting"), urls.posting_id(url, "linkedin.com").alias("none"), urls.company_from_host(url).alias("company"), more.alias("more"))


def fn78_routes(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, "/Join-Us-Now").otherwise(""))
    return _pages(spark, d).select("page_id", urls.locale_depth(urls.path_of(url)).alias("depth"), urls.route_family(url).alias("family"))


def fil05_hosts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    board = F.concat(F.lit("https://"), F.when(F.col("page_id") % 3 == 0, "x.").otherwise(""), F.when(F.col("page_id") % 2 == 0, "boards.greenhouse.io").otherwise("notjobs.lever.co"), F.lit("/a"))
    return _pages(spark, d).select(
        "page_id", urls.host_in(url, ["example.com", "tionsh.example.net"]).alias("listed"), urls.is_static_asset(F.concat(F.regexp_replace(url, "[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".html"))).alias("asset"),
        scores.is_board(board).alias("board"), scores.provider_of(board).alias("provider"), urls.same_site(url, F.lit("https://www.example.com/")).alias("same_site"),
    )


def fil12_rejections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 6
    url = F.when(k == 0, "ftp://files.company.com/a").when(k == 1, "https://user@company.com/").when(k == 2, "http://192.168.1.7/x").when(k == 3, "https://intranet/").when(k == 4, "https://company.com/%0Aa").otherwise("https://www.company.com/jobs")
    return _pages(spark, d).select("page_id", F.array_join(urls.url_rejections(url), ",").alias("codes"), urls.is_public_host(url).alias("public"))


def fil14_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    added = F.when(k == 0, "This job has been closed.").when(k == 1, "There are 0 open positions").when(k == 2, "This domain is for sale").when(k == 3, "We are hiring").otherwise("No longer accepting applications")
    body = F.concat_ws(" ", F.translate("text", "jJpP", "    "), added)
    return table(spark, d, "documents").select("doc_id", scores.is_closed_posting(body).alias("closed"), scores.is_empty_listing(body).alias("empty"), scores.is_parked(body).alias("parked"))


def fil17_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    label = F.when(k == 0, "View all open Jobs").when(k == 1, "Our openings").when(k == 2, "Careers").when(k == 3, F.col("p_name")).otherwise("Apply for positions today")
    url = F.when(k == 0, "https://a.com/jobs/eng-12345").when(k == 1, "https://a.com/x?JobId=7").when(k == 2, "https://a.com/en/Careers/").when(k == 3, "https://a.com/logo.SVG").otherwise("https://a.com/about")
    return table(spark, d, "part").select("p_partkey", scores.label_class(label).alias("label"), scores.page_kind(url).alias("kind"))


def fn21_titles(spark: SparkSession, d: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    turned = F.array_join(F.reverse(F.split(name, " ")), " ")
    candidate = F.when(k == 0, turned).when(k == 1, F.concat(name, F.lit(" - R"), (F.col("p_partkey") + 10_000).cast("string"))).when(k == 2, F.concat(F.lit("Sr "), name)).otherwise(F.lit("other words"))
    target = F.when(k == 2, F.concat(F.lit("Senior "), name)).otherwise(name)
    nurse = F.concat(F.lit("Registered Nurse RN "), name)
    return table(spark, d, "part").select(
        "p_partkey", text.title_identity(candidate, target).alias("identity"), text.publication_title_identity(F.concat(target, F.lit(" | Remote, US")), target).alias("published"),
        text.without_requisition(candidate).alias("bare"), F.array_join(text.title_sequence(nurse), " ").alias("sequence"),
    )


_PLACES = ("Austin, TX", "Austin, TX 78701; Remote", "Berlin, Germany", "Portland, Oregon", "London | Paris", "", "San Francisco, California + New York, NY")


def fn27_places(spark: SparkSession, d: str) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("p_partkey") % len(_PLACES) + 1).cast("int"))
    target = F.lit("Austin, Texas")
    return spread(table(spark, d, "part")).select(
        "p_partkey", F.size(text.location_options(place)).alias("options"), text.state_code(place).alias("state"), text.location_region(place).alias("region"),
        text.location_score(place, target).alias("score"), text.location_class(place, target).alias("class"), text.strict_location(place, target).alias("strict"),
        text.location_conflict(place, target).alias("conflict"), text.url_location_bonus(F.lit("https://a.com/jobs/austin-texas"), place).alias("bonus"),
    )


def fn47_companies(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.split("p_name", " "), 1)
    name = F.concat(F.initcap(word), F.lit(" Acme Widgets (Series B), Inc. LLC"))
    return table(spark, d, "part").select(
        "p_partkey", text.company_key(name).alias("key"), text.acronym(name).alias("acronym"), F.array_join(text.slug_variants(name), ",").alias("slugs"), text.slug(F.col("p_name")).alias("slug"),
        text.plain_company(F.concat(F.lit("A & "), F.upper(word))).alias("plain"), text.domain_confirms(F.concat(F.lit("www."), word, F.lit("acmewidgets.com")), name).alias("confirmed"),
        text.tenant_rank(name, F.concat(word, F.lit("acmewidgets"), F.when(F.col("p_partkey") % 2 == 0, "2").otherwise(""))).alias("tenant_rank"),
    )


def fn56_identities(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    body = F.concat_ws(" ", *[F.when(n > i, F.col("p_name")) for i in range(3)], F.lit("end"))
    city = text.government_identity(F.concat(F.lit(" City of "), F.col("p_name")), F.lit("Salem, OR"))
    reader = F.when(n == 0, "Our Executive team").when(n == 1, "Graduate program").when(n == 2, "Everyone").otherwise("For students")
    return table(spark, d, "part").select(
        "p_partkey", text.mentions(body, F.col("p_name")).alias("mentions"), text.contains_phrase(body, F.col("p_name")).alias("contains"), city["place"].alias("place"), city["state"].alias("state"),
        text.audience_mismatch(reader, F.when(F.col("p_partkey") % 8 == 1, "Intern recruiter").otherwise("Engineer")).alias("audience"),
    )


def fn58_reasons(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("<urlopen error timed out>", "HTTP Error 404: Not Found", "http_forbidden", "status 503", "Connection reset by peer", "invalid JSON at line 3", "odd", "429 Too Many Requests", "getaddrinfo failed", "captcha required")
    detail = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int"))
    found = privacy.reason_details(privacy.error_reason(detail))
    return table(spark, d, "events").groupBy(found["code"].alias("code"), found["retryable"].alias("retryable"), found["owner"].alias("owner")).agg(F.count("*").alias("n"))


def fn43_profile_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "  # ")).alias("b"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")).alias("a"))
    one = privacy.fingerprint(["b", "a"])
    return c.select("c_custkey", one.alias("fingerprint"), privacy.combined_digest(one, F.sha2("a", 256)).alias("combined"), privacy.ordered_digest(F.array("a", "b")).alias("ordered"), F.array_join(privacy.rotated(["x", "y", "z"], (F.col("c_custkey") % 3).cast("int")), "").alias("rotated"))


def fn70_credentials(spark: SparkSession, d: str) -> DataFrame:
    secret = F.concat(F.lit(" AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"), F.lit(" and ghp_"), F.repeat(F.lit("a"), 36), F.lit(" "))
    body = F.when(F.col("doc_id") % 2 == 0, secret).otherwise(F.lit("plain"))
    hits = privacy.credential_hits(body)
    return table(spark, d, "documents").select("doc_id", F.try_element_at(hits, F.lit("aws_access_key_id")).alias("aws"), F.try_element_at(hits, F.lit("github_token")).alias("github"), privacy.without_credentials(body).alias("clean"))


def fn75_tiers(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("external_apply", "first_party_ats_link", "targeted_opening_search", "guessed_path", "unheard_of")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", scores.evidence_tier(F.array(kind, F.lit("guessed_path"))).alias("tier"), scores.source_priority(kind).cast("int").alias("priority"))


def agg18_terminal_stage(spark: SparkSession, d: str) -> DataFrame:
    reasons = ("NO_PUBLIC_OPENINGS", "LINKEDIN_NATIVE_ONLY", "HTTP_FORBIDDEN", "PROVIDER_UNSUPPORTED", "OPENING_IDENTITY_AMBIGUOUS")
    code = F.element_at(F.array(*map(F.lit, reasons)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    stage = lambda name, status, reason, retry: F.struct(F.lit(name).alias("stage"), status.alias("status"), reason.alias("reason_code"), retry.alias("retryable"))
    stages = F.array(stage("a", F.lit("failed"), F.when(F.col("o_orderkey") % 5 == 1, code), F.lit(False)), stage("b", F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed"), F.when(F.col("o_orderkey") % 5 != 1, code), F.col("o_totalprice") > 250000))
    url, closed = F.when(F.col("o_custkey") % 4 == 0, "https://a.com/1"), F.col("o_custkey") % 4 == 1
    outcome = S.terminal_outcome(url, F.lit("none"), closed, stages, F.col("o_custkey") % 4 == 2)
    return table(spark, d, "orders").select("o_orderkey", S.terminal_stage(stages)["stage"].alias("stage"), outcome.alias("outcome"))


def agg22_pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    status = S.pipeline_status(
        F.when(F.col("l_tax") > 0.07, "failed").otherwise("success"), F.when(F.col("l_quantity") < 5, "success").when(F.col("l_quantity") < 10, "partial").otherwise("failed"),
        F.when(F.col("l_discount") < 0.04, "success").otherwise("failed"), F.when(F.col("l_returnflag") == "A", "success").otherwise("failed"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F",
    )
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def agg31_availability(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    found = S.availability(F.col("l_returnflag") == "A", F.col("l_tax") > 0.06, F.col("l_discount") > 0.07, F.col("l_linestatus") == "F", F.when(n == 1, 0).otherwise(1))
    return table(spark, d, "lineitem").groupBy(found.alias("decision")).agg(F.count("*").alias("n"))


def joi02_annotated(spark: SparkSession, d: str) -> DataFrame:
    both, bare, orphan = M.annotated(table(spark, d, "documents").select("doc_id", "lang").filter("lang <> 'de'"), table(spark, d, "labels"), ["doc_id"])
    return both.select("doc_id", F.lit("both").alias("side")).union(bare.select("doc_id", F.lit("unannotated"))).union(orphan.select("doc_id", F.lit("orphan")))


def joi03_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return M.key_violations(table(spark, d, "documents").select(F.lower(F.trim("lang")).alias("lang"), "n_chars"), ["lang", "n_chars"])


def joi01_sides(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return M.checked_join(results, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"], ["o_orderkey"], ["c_mktsegment"])


def cmp02_expectations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    failures = M.expectation_failures({"lang": (F.when(F.col("doc_id") % 2 == 0, F.lit("en")), F.col("lang")), "quality": (F.when(F.col("doc_id") % 3 == 0, F.lit(1)), F.col("quality").cast("int"))})
    return docs.select("doc_id", F.array_join(failures, ",").alias("failures"))


def cmp03_compatible(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    pairs = docs.alias("a").join(docs.alias("b"), F.col("a.doc_id") + 1 == F.col("b.doc_id"))
    return pairs.select(F.col("a.doc_id").alias("doc_id"), M.compatible("a", "b", ["lang", "source"]).alias("compatible"))


def cmp08_reconciled(spark: SparkSession, d: str) -> DataFrame:
    return M.reconciled({"documents": table(spark, d, "documents"), "labels": table(spark, d, "labels"), "again": table(spark, d, "documents").filter("doc_id is not null")})


def cmp10_identity_chain(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = lambda test, value: F.when(test, value)
    row = {
        "hiring_entity": name(k % 2 == 0, "acme"), "hiring_verified": k % 3 != 0, "provider_entity": F.when(k % 5 == 0, "Other").otherwise("ACME"), "provider": name(k % 7 != 0, "lever"), "provider_tenant": F.lit("t"),
        "provider_board": F.lit("b"), "provider_verified": F.lit(True), "provider_evidence": F.lit("e"), "opening_entity": F.lit("acme"), "opening_provider": F.lit("lever"), "opening_tenant": F.lit("T"),
        "opening_board": F.lit("b"), "opening_url": name(k % 11 != 0, "https://a.com/1"), "selected_url": name(k % 11 != 0, F.when(k % 13 == 0, "https://a.com/2").otherwise("https://a.com/1")),
    }
    codes = M.identity_chain(row)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(codes, ",").alias("codes"), M.verdict(codes, row["opening_url"].isNotNull(), k % 17 != 0).alias("verdict"))


def ext27_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.length(H.visible_text(F.col("html"))).alias("n_visible"), F.sha2(H.visible_text(F.col("html")), 256).alias("sha"))


QUERIES = {
    f.__name__: f
    for f in (
        fn02_url_equivalence, fn05_normalized, fn10_sanitized, fn13_unwrapped, fn15_url_parts, fn78_routes, fil05_hosts, fil12_rejections, fil14_texts, fil17_labels, fn21_titles, fn27_places,
        fn47_companies, fn56_identities, fn58_reasons, fn43_profile_fingerprint, fn70_credentials, fn75_tiers, agg18_terminal_stage, agg22_pipeline_status, agg31_availability, joi01_sides,
        joi02_annotated, joi03_key_violations, cmp02_expectations, cmp03_compatible, cmp08_reconciled, cmp10_identity_chain, ext27_visible_text,
    )
}

_URL = "regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)([?]([^#]*))?(#.*)?$', ['scheme', 'host', 'path', 'q', 'query', 'fragment'])"
_KEPT = "case when u.q = '' or u.query like 'utm_%' then '' else '?' || u.query end"
_PLACE_ROWS = (
    (1, "TX", "us", 12, "region", True, False, 4), (2, "TX", "us", 12, "mismatch", True, False, 4), (1, None, "de", 0, "mismatch", False, False, 0), (1, "OR", "us", 8, "mismatch", False, True, 0),
    (2, None, "uk", 0, "mismatch", False, False, 0), (0, None, None, 0, "missing", False, False, 0), (2, "NY", "us", 8, "mismatch", False, True, 0),
)

ORACLES = {
    "fn02_url_equivalence": r"""
select page_id, true as folded, false as strict, not contains(url, '://www.') as loose, regexp_extract(rtrim(lower(regexp_extract(url, '^[^?#]*')), '/'), '^https?://[^/]+(/[^/]+)?') as tenant from pages""",
    "fn05_normalized": f"""
with p as (select page_id, url, {_URL} as u from pages)
select page_id, u.scheme || '://' || u.host || u.path || {_KEPT} as normal, 'https://' || u.host || u.path || {_KEPT} as bare, cast(null as varchar) as mail,
  u.scheme || '://' || u.host || case when length(u.path) - length(replace(u.path, '/', '')) >= 3 then '/' || split_part(u.path, '/', 2) else '' end || '/x/y?z=' || page_id as resolved from p""",
    "fn10_sanitized": """
select page_id, regexp_replace(url, '[?#].*$', '') || '?token=[redacted]&page=2&client_secret=[redacted]&API_KEY=[redacted]' as clean, 'POST' as method, sha256(html) as body from pages""",
    "fn13_unwrapped": "select page_id, url as plain, url as coded, 'https://search.example/?q=x' as same, regexp_extract(url, '^[a-z]+://[^/?#]*') as origin from pages",
    "fn15_url_parts": f"""
with p as (select page_id, url, {_URL} as u from pages), q as (select *, regexp_replace(u.host, '^www[.]', '') as host, split_part(u.path, '/', 2) as s from p)
select page_id, case when s in ('de', 'fr', 'uk', 'ca', 'au', 'in', 'jp', 'br', 'mx', 'ie', 'nz', 'sg', 'us') then s end as region, cast(page_id + 1000000 as varchar) as posting, cast(null as varchar) as none,
  array_to_string(list_transform(string_split(replace(split_part(host, '.', 1), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as company,
  u.scheme || '://' || u.host || u.path || u.q || case when u.q = '' then '?' else '&' end || 'q=a+b&n=' || page_id || u.fragment as more from q""",
    "fn78_routes": f"""
with p as (select page_id, {_URL} as u from pages), q as (select page_id, list_filter(string_split(u.path, '/'), lambda s: s <> '') as s from p),
r as (select page_id, s, case when regexp_matches(s[1], '^[a-z][a-z]$') then 1 else 0 end as n from q)
select page_id, n as depth, '/' || array_to_string(list_concat(s[n + 1:], case when page_id % 2 = 0 then ['join'] else [] end), '/') as family from r""",
    "fil05_hosts": f"""
with p as (select page_id, url, {_URL} as u from pages)
select page_id, u.host = 'example.com' or ends_with(u.host, '.example.com') or u.host = 'tionsh.example.net' or ends_with(u.host, '.tionsh.example.net') as listed, page_id % 2 = 0 as asset, page_id % 2 = 0 as board,
  case when page_id % 2 = 0 then 'greenhouse' end as provider, u.host = 'example.com' or ends_with(u.host, '.example.com') as same_site from p""",
    "fil12_rejections": """
select page_id, case page_id % 6 when 0 then 'not_http' when 1 then 'credentials' when 2 then 'private_host' when 3 then 'private_host' when 4 then 'control_characters' else '' end as codes,
  page_id % 6 not in (2, 3) as public from pages""",
    "fil14_texts": "select doc_id, doc_id % 5 in (0, 4) as closed, doc_id % 5 = 1 as empty, doc_id % 5 = 2 as parked from documents",
    "fil17_labels": """
select p_partkey, case p_partkey % 5 when 0 then 'command' when 1 then 'object' when 2 then 'object' end as label,
  case p_partkey % 5 when 0 then 'detail' when 1 then 'detail' when 2 then 'listing' when 3 then 'asset' else 'other' end as kind from part""",
    "fn21_titles": r"""
with p as (select p_partkey, p_name, p_partkey % 4 as k, string_split(p_name, ' ') as w from part)
select p_partkey, k <> 3 as identity, true as published, case k when 0 then w[2] || ' ' || w[1] when 1 then p_name when 2 then 'Sr ' || p_name else 'other words' end as bare, 'rn ' || p_name as sequence from p""",
    "fn27_places": "select p_partkey, options, state, region, score, class, strict, conflict, bonus from part join (values "
    + ", ".join("(" + ", ".join([str(i), *["null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row]]) + ")" for i, row in enumerate(_PLACE_ROWS))
    + f") v(i, options, state, region, score, class, strict, conflict, bonus) on p_partkey % {len(_PLACE_ROWS)} = i",
    "fn47_companies": r"""
with p as (select p_partkey, p_name, split_part(p_name, ' ', 1) as w from part)
select p_partkey, w || 'acmewidgets' as key, w[1] || 'aw' as acronym, w || 'acmewidgets,' || w || '-acme-widgets' || case when length(w) >= 4 then ',' || w else '' end as slugs, replace(p_name, ' ', '-') as slug,
  'a ' || w as plain, true as confirmed, case when p_partkey % 2 = 0 then 1 else 0 end as tenant_rank from p""",
    "fn56_identities": """
select p_partkey, cast(least(p_partkey % 4, 3) as integer) as mentions, p_partkey % 4 > 0 as contains, p_name as place, 'OR' as state,
  case when p_partkey % 4 = 0 then 'executive' when p_partkey % 8 in (3, 5, 7) then 'early-career' end as audience from part""",
    "fn58_reasons": """
with c as (select * from (values (0, 'NETWORK_TIMEOUT', true, 'network'), (1, 'HTTP_NOT_FOUND', false, 'external'), (2, 'HTTP_FORBIDDEN', false, 'external'), (3, 'SERVER_ERROR', true, 'external'),
  (4, 'CONNECTION_FAILED', true, 'network'), (5, 'PARSING_FAILED', false, 'parser'), (6, 'FETCH_FAILED', true, 'network'), (7, 'RATE_LIMITED', true, 'external'), (8, 'DNS_FAILED', true, 'network'),
  (9, 'CAPTCHA', false, 'external')) v(i, code, retryable, owner))
select case when code = 'CAPTCHA' then 'BOT_PROTECTION' else code end as code, retryable, owner, count(*) as n from events join c on event_id % 10 = i group by 1, 2, 3""",
    "fn43_profile_fingerprint": r"""
with c as (select c_custkey, trim(regexp_replace('  ' || replace(c_name, '#', '  # '), '\s+', ' ', 'g')) as b, '  ' || replace(c_name, '#', '  # ') as rb,
  case when c_custkey % 2 = 0 then '' else c_mktsegment end as a, case when c_custkey % 2 = 0 then ' ' else c_mktsegment end as ra from customer),
f as (select *, sha256('{' || case when a <> '' then '"a":"' || a || '",' else '' end || '"b":"' || b || '"}') as fingerprint from c)
select c_custkey, fingerprint, sha256(fingerprint || chr(10) || sha256(ra)) as combined, sha256(ra || chr(10) || rb) as ordered,
  case c_custkey % 3 when 0 then 'xyz' when 1 then 'yzx' else 'zxy' end as rotated from f""",
    "fn70_credentials": """
select doc_id, case when doc_id % 2 = 0 then 1 end as aws, case when doc_id % 2 = 0 then 1 end as github, case when doc_id % 2 = 0 then ' [redacted] and [redacted] ' else 'plain' end as clean from documents""",
    "fn75_tiers": """
select event_id, case event_id % 5 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as tier, case event_id % 5 when 0 then 500 when 1 then 400 when 2 then 300 when 3 then 100 else 0 end as priority from events""",
    "agg18_terminal_stage": """
with r as (select *, o_orderkey % 5 as k, case when o_orderkey % 5 = 1 then 'a' when o_orderstatus <> 'F' then 'b' end as stage from orders)
select o_orderkey, stage, case when o_custkey % 4 = 0 then 'exact_opening' when o_custkey % 4 = 1 then 'source_closed' when stage is null then 'other_non_success' when k = 0 then 'no_public_openings'
  when k = 4 then 'identity_ambiguous' when stage = 'b' and o_totalprice > 250000 then 'retryable_failure' when k = 1 then 'linkedin_native_only'
  when k = 2 and o_custkey % 4 = 2 then 'external_blocked' when k = 2 then 'discovery_unresolved' else 'unsupported_capability' end as outcome from r""",
    "agg22_pipeline_status": """
select case when l_tax > 0.07 then 'failed' when l_quantity < 5 then 'success' when l_discount < 0.04 and l_quantity < 10 then 'partial' when l_discount < 0.04 then 'success'
  when l_returnflag in ('A', 'R') then 'partial' when l_linestatus = 'F' then 'unsupported' else 'failed' end as status, count(*) as n from lineitem group by 1""",
    "agg31_availability": """
select case when l_returnflag = 'A' then 'source_posting_closed' when l_tax > 0.06 then 'identity_ambiguous' when l_discount > 0.07 then 'inventory_incomplete'
  when l_linestatus = 'F' and l_linenumber = 1 then 'verified_inventory_empty' when l_linestatus = 'F' then 'verified_inventory_no_match' else 'inventory_incomplete' end as decision, count(*) as n from lineitem group by 1""",
    "joi01_sides": """
select coalesce(o_custkey, c_custkey) as k, o_orderkey, c_mktsegment, case when o_orderkey is null then 'right_only' when c_custkey is null then 'left_only' else 'both' end as side
  from orders full join customer on o_custkey = c_custkey""",
    "joi02_annotated": """
with r as (select doc_id from documents where lang <> 'de')
select coalesce(r.doc_id, l.doc_id) as doc_id, case when r.doc_id is null then 'orphan' when l.doc_id is null then 'unannotated' else 'both' end as side from r full join labels l on r.doc_id = l.doc_id""",
    "joi03_key_violations": "select lower(trim(lang)) as lang, n_chars, count(*) as n from documents group by 1, 2 having count(*) > 1",
    "cmp02_expectations": """
select d.doc_id, concat_ws(',', case when d.doc_id % 2 = 0 and lang is distinct from 'en' then 'lang' end, case when d.doc_id % 3 = 0 and quality is distinct from 1 then 'quality' end) as failures
  from documents d left join labels l on d.doc_id = l.doc_id""",
    "cmp03_compatible": "select a.doc_id, a.lang is not distinct from b.lang and a.source is not distinct from b.source as compatible from documents a join documents b on a.doc_id + 1 = b.doc_id",
    "cmp08_reconciled": """
with c as (select 0 as ord, 'documents' as step, count(*) as n from documents union all select 1, 'labels', count(*) from labels union all select 2, 'again', count(doc_id) from documents)
select ord, step, n, n = (select n from c where ord = 0) as matches from c""",
    "cmp10_identity_chain": """
with r as (select o_orderkey, o_orderkey as k from orders),
c as (select *, case when k % 11 = 0 then '' else concat_ws(',', case when k % 2 <> 0 then 'HIRING_IDENTITY_MISSING' end, case when k % 3 = 0 then 'HIRING_RELATIONSHIP_UNVERIFIED' end, case when k % 7 = 0 then 'PROVIDER_IDENTITY_MISSING' end,
  case when k % 2 = 0 and k % 5 = 0 then 'HIRING_PROVIDER_ENTITY_MISMATCH' end, case when k % 5 = 0 then 'PROVIDER_OPENING_ENTITY_MISMATCH' end, case when k % 13 = 0 then 'OPENING_URL_MISMATCH' end) end as codes from r)
select o_orderkey, codes, case when k % 11 = 0 then 'not_applicable' when k % 17 = 0 then 'unavailable' when codes = '' then 'verified' else 'rejected' end as verdict from c""",
    "ext27_visible_text": r"""
with v as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as t from pages)
select page_id, length(t) as n_visible, sha256(t) as sha from v""",
}
