"""Titles, places and names as column expressions over token arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no title.
TITLE_STOPWORDS = ("a", "an", "and", "at", "for", "i", "ii", "iii", "in", "of", "the", "to")
# Spellings of one title word.
TITLE_ALIASES = {"sr": "senior", "jr": "junior", "i": "level1", "ii": "level2", "iii": "level3", "iv": "level4", "eng": "engineer", "dev": "developer", "mgr": "manager", "assoc": "associate", "asst": "assistant"}
# Legal forms that end a company's name.
LEGAL_FORMS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "plc", "llp", "lp", "bv", "pty", "holdings", "group")
# Two-letter codes of the United States by name.
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
COUNTRY_WORDS = ("united", "states", "usa", "us", "uk", "kingdom", "canada", "germany", "france", "india", "australia", "remote")


def _let(value: Column, f) -> Column:
    """``f(value)`` with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def merged_nursing(tokens: Column) -> Column:
    """``registered nurse`` as ``rn``, neighbours that repeat dropped."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    merged = F.regexp_replace(joined, " registered  nurse ", " rn ")
    once = F.regexp_replace(merged, r" (\S+) (?: \1 )+", " $1 ")
    return F.filter(F.split(once, " +"), lambda w: w != "")


def title_tokens(title: Column) -> Column:
    """The distinct tokens of a title: two characters and over, no stopwords, nursing titles merged; sorted."""
    kept = F.filter(merged_nursing(words(title)), lambda w: (F.length(w) >= 2) & ~w.isin(*TITLE_STOPWORDS))
    return F.sort_array(F.array_distinct(kept))


def title_sequence(title: Column) -> Column:
    """Tokens in order with aliases resolved and nursing titles merged."""
    alias = F.create_map(*[F.lit(x) for kv in TITLE_ALIASES.items() for x in kv])
    return F.transform(merged_nursing(words(title)), lambda w: F.coalesce(F.try_element_at(alias, w), w))


def without_requisition(title: Column) -> Column:
    """A code at the end, as in ``Engineer - R12345`` or ``(#1234)``, cut off."""
    return F.trim(F.regexp_replace(title, r"(?i)\s*(?:[-–—|,]\s*|\()\s*(?:req(?:uisition)?\.?\s*(?:id)?\s*[:#]?\s*|job\s*(?:id)?\s*[:#]?\s*|#)?[a-z]{0,4}-?\d{3,}\)?\s*$", ""))


def title_score(candidate: Column, target: Column) -> Column:
    """int(70 recall + 30 precision) of the token sets, and 50 when the trimmed titles are equal in lower case; 0 without tokens."""
    a, b = title_tokens(candidate), title_tokens(target)
    common = F.size(F.array_intersect(a, b))
    score = F.when((F.size(a) > 0) & (F.size(b) > 0), F.floor(70 * common / F.size(b) + 30 * common / F.size(a) + F.lit(1e-9))).otherwise(0)
    same = F.lower(F.trim(candidate)) == F.lower(F.trim(target))
    return (score + F.when(F.coalesce(same, F.lit(False)), 50).otherwise(0)).cast("int")


def title_identity(candidate: Column, target: Column) -> Column:
    """The same tokens in any order, or the target's tokens in order within the candidate's."""
    a, b = title_sequence(without_requisition(candidate)), title_sequence(without_requisition(target))
    found = F.aggregate(a, F.lit(0), lambda k, w: F.when(F.get(b, k) == w, k + 1).otherwise(k))
    return (F.size(b) > 0) & ((F.sort_array(a) == F.sort_array(b)) | (found == F.size(b)))


def publication_title_identity(candidate: Column, target: Column) -> Column:
    """Equal sequences once levels and aliases are resolved; more words may only follow a dash, bar, comma or bracket."""
    head = F.regexp_replace(candidate, r"\s*(?:[|,(]|\s[-–—]\s).*$", "")
    b = title_sequence(without_requisition(target))
    return (F.size(b) > 0) & ((title_sequence(without_requisition(candidate)) == b) | (title_sequence(head) == b))


def location_options(location: Column) -> Column:
    """Parts between ``;``, ``|``, newlines and `` + ``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(location, F.lit("")), r"[;|\n]|\s\+\s"), lambda s: F.trim(s)), lambda s: s != "")


def state_code(location: Column) -> Column:
    """The United States' state named in the text: a code after a comma or at the end, else a name; null if none."""
    codes = "|".join(sorted(set(US_STATES.values())))
    code = F.nullif(F.regexp_extract(location, rf"(?:^|,\s*)({codes})(?:\s*\d{{5}})?\s*(?:[,;|+]|$)", 1), F.lit(""))
    low = F.concat(F.lit(" "), F.array_join(words(location), " "), F.lit(" "))
    names = lambda t: reduce(lambda acc, kv: acc.when(t.contains(f" {kv[0]} "), kv[1]), sorted(US_STATES.items(), key=lambda kv: -len(kv[0])), F.when(F.lit(False), ""))
    return F.coalesce(code, _let(low, names))


def location_region(location: Column) -> Column:
    """``us`` for a state or the country's name, else a country named in the text, else null."""
    named = {"uk": ("uk", "england", "scotland", "wales", "london"), "ca": ("canada", "ontario", "toronto"), "de": ("germany", "berlin"), "fr": ("france", "paris"), "in": ("india", "bangalore"), "au": ("australia", "sydney"), "ie": ("ireland", "dublin")}
    other = _let(words(location), lambda w: reduce(lambda acc, kv: acc.when(F.arrays_overlap(w, F.array(*map(F.lit, kv[1]))), kv[0]), named.items(), F.when(F.lit(False), "")))
    us = state_code(location).isNotNull() | F.lower(location).rlike(r"\b(united states|usa|u\.s\.)\b")
    return F.when(us, "us").otherwise(other)


def location_score(candidate: Column, target: Column) -> Column:
    """20 for equal text, else 4 a common token up to 12; 8 more for the same region; 0 where either is missing."""
    a, b = words(candidate), words(target)
    overlap = F.least(F.lit(12), 4 * F.size(F.array_intersect(a, b)))
    score = F.when(F.array_join(a, " ") == F.array_join(b, " "), 20).otherwise(overlap)
    region = F.when(F.coalesce(location_region(candidate) == location_region(target), F.lit(False)), 8).otherwise(0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score + region).otherwise(0).cast("int")


def url_location_bonus(url: Column, target: Column) -> Column:
    """4 for each of the place's tokens in the url's path, up to 12."""
    path = words(F.regexp_replace(url, r"^[a-z]+://[^/]*|[?#].*$", ""))
    return F.least(F.lit(12), 4 * F.size(F.array_intersect(F.array_distinct(path), F.array_distinct(words(target)))))


def location_class(candidate: Column, target: Column) -> Column:
    """missing, exact, remote, overlap, region or mismatch; the first that fits."""
    a, b = words(candidate), words(target)
    common = F.size(F.array_intersect(a, b))
    state_a, state_b = state_code(candidate), state_code(target)
    remote = lambda w: F.array_contains(w, "remote")
    long_one = F.exists(F.array_intersect(a, b), lambda w: F.length(w) >= 5)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "missing")
        .when(F.array_join(a, " ") == F.array_join(b, " "), "exact")
        .when(remote(a) != remote(b), "mismatch")
        .when(F.coalesce(state_a != state_b, F.lit(False)), "mismatch")
        .when(common >= 2, "overlap")
        .when(F.coalesce(location_region(candidate) == location_region(target), F.lit(False)), "region")
        .when(long_one, "overlap")
        .otherwise("mismatch")
    )


def strict_location(candidate: Column, target: Column) -> Column:
    """Equal when normalised; else one option whose first comma part shares a token with the target's, or, where either has but one
    part, any token but a country's."""
    b = words(target)
    first = lambda s: words(F.substring_index(s, ",", 1))
    two = lambda s: F.size(F.split(s, ",")) >= 2
    plain = lambda w: F.array_except(w, F.array(*map(F.lit, COUNTRY_WORDS)))
    fits = F.exists(location_options(candidate), lambda s: F.when(two(s) & two(target), F.arrays_overlap(first(s), first(target))).otherwise(F.arrays_overlap(plain(words(s)), plain(b))))
    return F.coalesce((F.array_join(words(candidate), " ") == F.array_join(b, " ")) | fits, F.lit(False))


def location_conflict(candidate: Column, target: Column) -> Column:
    """Every option names a state other than the target's; false without options or states."""
    options = location_options(candidate)
    want = state_code(target)
    return F.coalesce((F.size(options) > 0) & F.forall(options, lambda s: F.coalesce(state_code(s) != want, F.lit(False))), F.lit(False))


def company_tokens(name: Column) -> Column:
    """Tokens without bracketed remarks and the legal forms at the end."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " ")
    text = F.concat(F.lit(" "), F.array_join(words(bare), " "))
    return F.filter(F.split(F.regexp_replace(text, rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", ""), " "), lambda w: w != "")


def company_key(name: Column) -> Column:
    return F.array_join(company_tokens(name), "")


def plain_company(name: Column) -> Column:
    """Lower case, ``&`` as a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " "), r"\s+", " "))


def acronym(name: Column) -> Column:
    """First letters of three tokens or more, else null."""
    t = company_tokens(name)
    return F.when(F.size(t) >= 3, F.array_join(F.transform(t, lambda w: F.substring(w, 1, 1)), ""))


def slug(text: Column) -> Column:
    return F.array_join(words(text), "-")


def slug_variants(name: Column) -> Column:
    """Distinct board slugs to try: joined, dashed, and the first token if long enough, in this order."""
    t = company_tokens(name)
    first = F.get(t, F.lit(0))
    return F.array_distinct(F.filter(F.array(F.array_join(t, ""), F.array_join(t, "-"), F.when(F.length(first) >= 4, first)), lambda s: s.isNotNull() & (s != "")))


def tenant_rank(entity: Column, tenant: Column) -> Column:
    """0 equal keys, 1 the tenant adds digits, a legal form or itself again, 2 the acronym, 3 the acronym and a suffix; else null."""
    key, t, short = company_key(entity), F.array_join(words(tenant), ""), acronym(entity)
    rest = F.when(t.startswith(key), F.regexp_replace(t, F.concat(F.lit("^"), key), F.lit("")))
    return (
        F.when(key == "", None)
        .when(t == key, 0)
        .when(rest.rlike(rf"^(\d+|{'|'.join(LEGAL_FORMS)})$") | (rest == key), 1)
        .when(t == short, 2)
        .when(t.startswith(short), 3)
    )


def contains_phrase(text: Column, phrase: Column) -> Column:
    """The phrase's tokens stand in a row in the text."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return (F.size(words(phrase)) > 0) & pad(text).contains(pad(phrase))


def domain_confirms(domain: Column, name: Column) -> Column:
    """The first label of the domain is the company's key."""
    label = F.regexp_replace(F.substring_index(F.regexp_replace(F.lower(domain), r"^www\.", ""), ".", 1), "[^a-z0-9]", "")
    return (company_key(name) != "") & (label == company_key(name))


def government_identity(name: Column, location: Column) -> Column:
    """struct(kind, place, state) of names like ``City of X``; null otherwise."""
    kind, place = F.regexp_extract(name, r"(?i)^\s*(city|town|village|county|state) of\s+(.+?)\s*$", 1), F.regexp_extract(name, r"(?i)^\s*(city|town|village|county|state) of\s+(.+?)\s*$", 2)
    return F.when(kind != "", F.struct(F.lower(kind).alias("kind"), place.alias("place"), state_code(location).alias("state")))


def mentions(text: Column, name: Column) -> Column:
    """How often the name's tokens stand in a row in the text."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), "  "), F.lit(" "))
    return F.when(F.size(words(name)) > 0, F.size(F.split(pad(text), F.concat(F.lit(r"\Q"), pad(name), F.lit(r"\E")), -1)) - 1).otherwise(0)


# Markers of pages for a certain audience, and of titles that belong to it.
AUDIENCES = {
    "executive": (("executive", "partner-jobs"), ("executive", "partner", "principal", "director")),
    "early-career": (("early-career", "early_career", "early careers", "student", "graduate", "internship", "university"), ("student", "graduate", "intern", "apprentice")),
}


def audience_mismatch(text: Column, target: Column) -> Column:
    """``executive`` or ``early-career`` where the text (path and label) is for such readers and the title is not; null also without a title."""
    low, title = F.lower(F.coalesce(text, F.lit(""))), F.lower(target)
    holds = lambda c, markers: reduce(lambda a, b: a | b, [c.contains(m) for m in markers])
    return reduce(lambda acc, kv: acc.when(holds(low, kv[1][0]) & ~holds(title, kv[1][1]), kv[0]), AUDIENCES.items(), F.when(F.coalesce(target, F.lit("")) == "", None))
