"""URL functions as column expressions: canonical forms, parts, redaction, search-result unwrapping.

All of them return null for null, and treat text without a scheme as said per function.  Nothing raises on a bad url.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
# Query keys whose values are secrets.
SENSITIVE_KEYS = (
    "access_token", "api_key", "api-key", "apikey", "auth", "authorization", "code", "id_token", "key", "password",
    "refresh_token", "secret", "session", "sig", "signature", "state", "token",
)
SENSITIVE_SUFFIXES = ("_token", "-token", "_secret", "-secret", "_password", "_key")
STATIC_EXTENSIONS = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "woff", "woff2", "ttf", "pdf", "zip", "mp4", "xml", "json")
REDACTED = "[redacted]"

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority_of(url: Column) -> Column:
    """User, host and port as written, in lower case."""
    return F.lower(_part(url, 2))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return _part(url, 4)


def fragment_of(url: Column) -> Column:
    return _part(url, 5)


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(authority_of(url), r"^.*@", ""), r":\d*$", "")


def domain_of(url: Column) -> Column:
    """Host and port without a leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(authority_of(url), r"^.*@", ""), r"^www\.", "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def path_depth(url: Column) -> Column:
    """How many path segments are not empty."""
    return F.when(url.isNotNull(), F.size(path_segments(url)))


def query_params(url: Column) -> Column:
    """The query's ``key=value`` pieces in order, empty ones left out."""
    return F.filter(F.split(query_of(url), "&"), lambda p: p != "")


def _key(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def without_tracking(pairs: Column, fold: bool) -> Column:
    """Pieces whose key is no tracking parameter, compared in lower case if ``fold``."""
    return F.filter(pairs, lambda p: ~(F.lower(_key(p)) if fold else _key(p)).isin(*TRACKING_PARAMS))


def _joined(pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")


def _host_port(url: Column) -> Column:
    authority = F.regexp_replace(F.regexp_replace(authority_of(url), r"^.*@", ""), r"\.(?=(:\d*)?$)", "")
    default = F.when(scheme_of(url) == "https", F.regexp_replace(authority, r":(443)?$", "")).otherwise(authority)
    return F.when(scheme_of(url) == "http", F.regexp_replace(authority, r":(80)?$", "")).otherwise(default)


def ascii_hosts(urls: pd.Series) -> pd.Series:
    """Urls with the host's labels that are not ASCII in IDNA form; null where a label has none."""

    def one(url: str) -> str | None:
        head, slashes, rest = url.partition("://")
        cut = re.search(r"[/?#]|$", rest).start()
        host, colon, port = rest[:cut].partition(":")
        try:
            return head + slashes + host.lower().encode("idna").decode() + colon + port + rest[cut:]
        except UnicodeError:
            return None

    out, other = urls.copy(), urls.notna() & ~urls.map(lambda u: u is None or u.isascii())
    out[other] = urls[other].map(one)
    return out


def canonical_international_url(url: Column) -> Column:
    """``canonical_url`` of urls whose hosts may hold any letters; a vectorised function turns these into IDNA form first."""
    return canonical_url(F.pandas_udf(ascii_hosts, "string")(url))


def canonical_url(url: Column) -> Column:
    """The strict form that identities are compared in, null unless it is http(s) with a host and without user or controls.

    Lower-case scheme and host without a trailing dot or default port, no trailing slash, tracking parameters dropped in any case; the order of
    the query and the fragment stay.
    """
    url = F.trim(url)
    path = F.regexp_replace(path_of(url), r"/+$", "")
    fragment = F.when(fragment_of(url) != "", F.concat(F.lit("#"), fragment_of(url))).otherwise("")
    out = F.concat(scheme_of(url), F.lit("://"), _host_port(url), path, _joined(without_tracking(query_params(url), True)), fragment)
    sound = scheme_of(url).isin("http", "https") & (host_of(url) != "") & ~authority_of(url).contains("@") & ~url.rlike(r"[\x00-\x20\x7F\\]")
    return F.when(sound & ~F.lower(url).rlike(r"%(0[0-9a-f]|1[0-9a-f]|7f)"), out)


def urls_equivalent(a: Column, b: Column, allow_www: bool = False) -> Column:
    """Equal canonical forms, with ``www.`` ignored if allowed; false where either has none."""
    x, y = canonical_url(a), canonical_url(b)
    if allow_www:
        x, y = (F.regexp_replace(c, r"^(https?://)www\.", "$1") for c in (x, y))
    return F.coalesce(x == y, F.lit(False))


def tenant_locator(url: Column) -> Column:
    """Scheme, host and first path segment: the prefix that all pages of a tenant share."""
    return F.regexp_extract(canonical_url(url), r"^https?://[^/?#]+(/[^/?#]+)?", 0)


def resolve_url(url: Column, base: Column) -> Column:
    """An absolute url from a link: absolute, ``//host``, ``/path``, ``?query`` or relative to the base's folder, dots resolved."""
    root = F.concat(scheme_of(base), F.lit("://"), authority_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    path = F.concat(F.when(folder == "", "/").otherwise(folder), url)
    joined = (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme_of(base), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.rlike(r"^[?#]") | (url == ""), F.concat(root, path_of(base), F.when(url.startswith("#") & (query_of(base) != ""), F.concat(F.lit("?"), query_of(base))).otherwise(""), url))
        .otherwise(F.concat(root, path))
    )
    return let(joined, lambda u: F.concat(_without_dots(F.regexp_extract(u, r"^[^?#]*", 0)), F.regexp_extract(u, r"[?#].*$", 0)))


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` segments of the path resolved."""
    head, path = F.regexp_extract(url, r"^[A-Za-z][^:/]*:(//[^/]*)?", 0), F.regexp_replace(url, r"^[A-Za-z][^:/]*:(//[^/]*)?", "")
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.array_append(acc, s)),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(head, F.array_join(kept, "/"), tail)).otherwise(url)


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Resolved against ``base``, https where no scheme is given, without tracking parameters (case-sensitive) and fragment."""
    url = F.trim(url)
    full = resolve_url(url, base) if base is not None else F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url).otherwise(F.concat(F.lit("https://"), F.ltrim(F.regexp_replace(url, "^//", ""))))
    return let(full, lambda u: F.concat(scheme_of(u), F.lit("://"), authority_of(u), path_of(u), _joined(without_tracking(query_params(u), False))))


def safe_normalize_url(url: Column, base: Column | None = None) -> Column:
    """As ``normalize_url``; null unless the result is http(s) with a host."""
    return let(normalize_url(url, base), lambda u: F.when(u.rlike(r"^https?://[^/?#\s]+"), u))


def compare_key(url: Column) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"/+$", "")


def is_sensitive_key(key: Column) -> Column:
    """A secret's name: one of the list, or with one of the suffixes, in any case."""
    k = F.lower(F.trim(key))
    return k.isin(*SENSITIVE_KEYS) | reduce(lambda a, b: a | b, [k.endswith(s) for s in SENSITIVE_SUFFIXES])


def sanitize_url(url: Column) -> Column:
    """Values of sensitive query keys redacted, user and fragment dropped."""
    pairs = F.transform(query_params(url), lambda p: F.when(is_sensitive_key(_key(p)), F.concat(_key(p), F.lit("=" + REDACTED))).otherwise(p))
    authority = F.regexp_replace(authority_of(url), r"^.*@", "")
    head = F.when(authority_of(url) != "", F.concat(scheme_of(url), F.lit("://"), authority)).otherwise("")
    return F.concat(head, path_of(url), _joined(pairs))


def query_value(url: Column, key: str) -> Column:
    """The decoded value of the first parameter of this name, else null."""
    found = F.get(F.filter(query_params(url), lambda p: _key(p) == key), F.lit(0))
    return F.try_url_decode(F.regexp_replace(found, "^[^=]*=?", ""))


def unwrap_redirect(url: Column, keys: Sequence[str] = ("uddg", "url", "q", "u")) -> Column:
    """The target of a search engine's redirect: the first of the keys with an http(s) url, or ``a1`` and base64 of one."""
    out = url
    for key in reversed(keys):
        value = query_value(url, key)
        coded = F.translate(F.substring(value, 3, 100_000), "-_", "+/")
        padded = F.rpad(coded, F.ceil(F.length(coded) / 4).cast("int") * 4, "=")
        decoded = F.when(value.startswith("a1") & padded.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
        out = F.when(value.rlike("^https?://"), value).when(decoded.rlike("^https?://"), decoded).otherwise(out)
    return out


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)


# Regions by country-code domain and by the names that stand in host labels or first path segments.
REGION_DOMAINS = {"uk": "uk", "ca": "ca", "au": "au", "de": "de", "fr": "fr", "in": "in", "jp": "jp", "br": "br", "mx": "mx", "ie": "ie", "nz": "nz", "sg": "sg", "us": "us"}


def url_region(url: Column) -> Column:
    """Region from the country-code domain, else the first host label, else a locale as first path segment; else null."""
    host = host_of(url)
    by = lambda c: reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), REGION_DOMAINS.items(), F.when(F.lit(False), ""))
    first = F.lower(F.get(path_segments(url), F.lit(0)))
    locale = F.coalesce(F.nullif(F.regexp_extract(first, r"^[a-z]{2}[-_]([a-z]{2})$", 1), F.lit("")), F.when(first.rlike("^[a-z]{2}$"), first))
    return F.coalesce(by(F.substring_index(host, ".", -1)), by(F.substring_index(host, ".", 1)), by(locale))


def posting_id(url: Column, host: str) -> Column:
    """The digits (six or more) that end ``/jobs/view/...`` on ``host`` or a subdomain, else null."""
    found = F.regexp_extract(path_of(url), r"^/jobs/view/(?:.*-)?([0-9]{6,})/?$", 1)
    return F.when(((host_of(url) == host) | host_of(url).endswith("." + host)) & (found != ""), found)


def company_from_host(url: Column) -> Column:
    """The host's first label but ``www``, dashes as blanks, in title case."""
    return F.initcap(F.translate(F.substring_index(domain_of(url), ".", 1), "-_", "  "))


def add_query_params(url: Column, params: dict[str, Column | str]) -> Column:
    """The url with more parameters, before its fragment."""
    pairs = [F.concat(F.lit(k + "="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in params.items()]
    head, fragment = F.regexp_extract(url, r"^[^#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    return F.concat(head, F.when(head.contains("?"), "&").otherwise("?"), F.concat_ws("&", *pairs), fragment)


def is_static_asset(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(r"\.(" + "|".join(STATIC_EXTENSIONS) + ")$")


def host_in(url: Column, domains: Sequence[str]) -> Column:
    """The host equals one of the domains or is below it."""
    host = host_of(url)
    return reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains], F.lit(False))


def is_public_host(url: Column) -> Column:
    """No empty, one-label, local or private host."""
    host = host_of(url)
    private = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)|^\[|(^|\.)(localhost|local|internal|test|invalid|example)$"
    return (host != "") & host.contains(".") & ~host.rlike(private)


def url_rejections(url: Column) -> Column:
    """Why a url is not fit for output: an array of codes in fixed order, empty when it is."""
    rules = [
        ("not_http", ~scheme_of(url).isin("http", "https")),
        ("no_host", host_of(url) == ""),
        ("credentials", authority_of(url).contains("@")),
        ("control_characters", url.rlike(r"[\x00-\x1F\x7F]") | F.lower(url).rlike(r"%(0[0-9a-f]|1[0-9a-f]|7f)")),
        ("private_host", ~is_public_host(url)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules]), lambda x: x.isNotNull())


def same_site(a: Column, b: Column) -> Column:
    """Hosts equal, or one below the other, ``www.`` ignored."""
    x, y = (F.regexp_replace(host_of(c), r"^www\.", "") for c in (a, b))
    return (x != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def locale_depth(path: Column) -> Column:
    """0, 1 or 2 leading locale segments: ``en`` and ``en-us`` count one, ``us/en`` two."""
    s = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    one, two = F.coalesce(F.get(s, F.lit(0)).rlike(r"^[a-z]{2}([-_][a-z]{2})?$"), F.lit(False)), F.coalesce(F.get(s, F.lit(1)).rlike(r"^[a-z]{2}$"), F.lit(False))
    return F.when(one & two, 2).when(one, 1).otherwise(0)


def route_family(url: Column) -> Column:
    """The path in lower case without locale segments and trailing slash, ``join-...`` segments folded to ``join``."""
    s = F.transform(path_segments(url), lambda x: F.lower(x))
    rest = F.slice(s, locale_depth(path_of(url)) + 1, F.greatest(F.size(s), F.lit(1)))
    return F.concat(F.lit("/"), F.array_join(F.transform(rest, lambda x: F.regexp_replace(x, "^join-.*$", "join")), "/"))


def request_identity(method: Column, url: Column, body: Column | None = None) -> Column:
    """struct(method, sanitized_url, body_fingerprint): what a captured request is found again by."""
    body = F.lit(None).cast("string") if body is None else body
    return F.struct(F.upper(F.coalesce(method, F.lit("GET"))).alias("method"), sanitize_url(url).alias("sanitized_url"), F.sha2(body, 256).alias("body_fingerprint"))
