"""Continuity of identities in result records: rules that are rows, judged over VARIANT records in one projection; gates over whole measurements; and employers
matched to companies by a prefix of their tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.urls import authority_of, host_of, is_public_host, path_of, query_of, scheme_of
from .shared import exploded

_A = "identity_assertion"
_PARTS = ("hiring", "provider", "opening", "selection")
_SAME = ("provider", "opening", "selection")
# The rules of a record's continuity.  issue, stage, test, paths, values.  Stage 0 is judged for every record, stage 1 where there is
# an assertion, stage 2 where it has all four parts.  ``same_`` rules only speak where all paths are filled, which ``filled`` asks.
RULES: tuple[tuple[str, int, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("pipeline_not_success", 0, "is", ("pipeline_status",), ("success",)),
    ("output_validation_not_success", 0, "is", ("output_validation_status",), ("success",)),
    ("identity_assertion_missing", 0, "object", (_A,), ()),
    ("identity_not_verified", 1, "is", (f"{_A}.verdict",), ("verified",)),
    ("identity_failure_codes_present", 1, "empty", (f"{_A}.failure_codes",), ()),
    ("hiring_relationship_unverified", 1, "true", (f"{_A}.hiring.verified",), ()),
    ("provider_relationship_unverified", 1, "true", (f"{_A}.provider.relationship_verified",), ()),
    ("opening_identity_missing", 1, "object", (f"{_A}.opening",), ()),
    ("selection_identity_missing", 1, "object", (f"{_A}.selection",), ()),
    ("provider_not_typed", 2, "not", (f"{_A}.provider.provider",), ("", "unknown")),
    *[rule for f in ("provider", "tenant", "canonical_board_url") for rule in (
        (f"{f}_missing", 2, "filled", tuple(f"{_A}.{p}.{f}" for p in _SAME), ()),
        (f"{f}_continuity_mismatch", 2, "same_value", tuple(f"{_A}.{p}.{f}" for p in _SAME), ()),
    )],
    ("hiring_entity_missing", 2, "filled", tuple(f"{_A}.{p}.hiring_entity_name" for p in _PARTS[:3]), ()),
    ("hiring_entity_continuity_mismatch", 2, "same_name", tuple(f"{_A}.{p}.hiring_entity_name" for p in _PARTS[:3]), ()),
    ("source_company_continuity_mismatch", 2, "both_name", (f"{_A}.hiring.source_company_name", "company_name"), ()),
    ("opening_url_missing", 2, "filled", ("open_position_url", f"{_A}.candidate_opening_url", f"{_A}.opening.canonical_opening_url", f"{_A}.selection.canonical_opening_url"), ()),
    ("opening_url_continuity_mismatch", 2, "same_url", ("open_position_url", f"{_A}.candidate_opening_url", f"{_A}.opening.canonical_opening_url", f"{_A}.selection.canonical_opening_url"), ()),
    ("opening_url_not_safe_public_https", 2, "safe_url", ("open_position_url",), ()),
    ("selection_title_missing", 2, "nonblank", (f"{_A}.selection.title",), ()),
    ("selection_location_missing", 2, "nonblank_unless", (f"{_A}.selection.location", f"{_A}.location_classification"), ("title_qualifier", "url_qualifier", "title_location_independent", "url_location_independent")),
    ("location_not_verified", 2, "not", (f"{_A}.location_classification",), ("", "mismatch", "missing", "not_applicable")),
)


def at_path(record: Column, path: str) -> Column:
    return V.member(record, *path.split("."))


def string_at(record: Column, path: str) -> Column:
    """The string at a path as it stands; null for absent and other values."""
    value = at_path(record, path)
    return F.when(F.schema_of_variant(value) == "STRING", V.raw(value))


def by_precedence(record: Column, paths: Sequence[str]) -> Column:
    """The first text at one of the paths that is not blank, or whole number."""
    return F.coalesce(*[V.plain(at_path(record, p)) for p in paths])


def comparable_url(url: Column) -> Column:
    """Scheme, host, port unless it is 443, path without trailing slashes, and query; user and fragment dropped."""
    port = F.regexp_replace(F.regexp_extract(authority_of(url), r":\d+$", 0), "^:443$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.concat(scheme_of(url), F.lit("://"), host_of(url), port, F.when(path == "", "/").otherwise(path), F.when(query_of(url) != "", F.concat(F.lit("?"), query_of(url))).otherwise(""))


_FORMS = {
    "value": lambda c: F.lower(F.trim(c)), "name": lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), "url": comparable_url,
}


def _holds(record: Column, test: str, paths: Sequence[str], values: Sequence[str], string: Mapping[str, Column]) -> Column:
    """Whether a rule's test holds; a null counts as broken.  ``string`` has the strings at the paths."""
    texts = [string[p] for p in paths]
    filled = reduce(lambda a, b: a & b, [t.isNotNull() & (t != "") for t in texts])
    if test.startswith("same_"):
        form = _FORMS[test.removeprefix("same_")]
        return ~filled | (F.size(F.array_distinct(F.array(*map(form, texts)))) == 1)
    blank = F.coalesce(F.trim(texts[0]), F.lit("")) == ""
    return {
        "is": lambda: texts[0].isin(*values), "not": lambda: texts[0].isNotNull() & ~texts[0].isin(*values), "object": lambda: V.members(at_path(record, paths[0])).isNotNull(),
        "true": lambda: F.try_variant_get(at_path(record, paths[0]), "$", "boolean") & (F.schema_of_variant(at_path(record, paths[0])) == "BOOLEAN"),
        "empty": lambda: F.size(V.elements(at_path(record, paths[0]))) == 0, "filled": lambda: filled, "both_name": lambda: _FORMS["name"](texts[0]) == _FORMS["name"](texts[1]),
        "safe_url": lambda: (scheme_of(texts[0]) == "https") & ~authority_of(texts[0]).rlike(r"@|:(?!443$)") & is_public_host(texts[0]),
        "nonblank": lambda: ~blank, "nonblank_unless": lambda: ~blank | F.coalesce(texts[-1].isin(*values), F.lit(False)),
    }[test]()


def continuity_issues(rows: DataFrame, record: str, rules: Sequence[tuple] = RULES, name: str = "issues") -> DataFrame:
    """The rows with the sorted distinct issues of a VARIANT record; a null or other record counts as one without an assertion."""
    value = F.col(record)
    asserted = V.members(at_path(value, _A)).isNotNull()
    whole = reduce(lambda a, b: a & b, [V.members(at_path(value, f"{_A}.{p}")).isNotNull() for p in _PARTS])
    # the strings are columns of a projection of their own: each is read once, however many tests use it
    string = {p: f"_string_{k}" for k, p in enumerate(dict.fromkeys(p for _, _, _, paths, _ in rules for p in paths))}
    staged = rows.withColumns({"_asserted": F.coalesce(asserted, F.lit(False)), "_whole": F.coalesce(asserted & whole, F.lit(False)), **{c: string_at(value, p) for p, c in string.items()}})
    texts = {p: F.col(c) for p, c in string.items()}
    due = {0: F.lit(True), 1: F.col("_asserted"), 2: F.col("_whole")}
    broken = [F.when(due[stage] & ~F.coalesce(_holds(value, test, paths, values, texts), F.lit(False)), issue) for issue, stage, test, paths, values in rules]
    return staged.withColumn(name, F.array_sort(F.array_distinct(F.array_compact(F.array(*broken))))).drop("_asserted", "_whole", *string.values())


def measurement_gate(sides: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row over several tables that should hold the same keys, first side first: counts a side, keys not on every side, repeated keys, and issues in order."""
    tagged = reduce(DataFrame.unionByName, [df.select(F.col(key).alias("key"), F.lit(side).alias("side")) for side, df in sides.items()])
    per_key = tagged.groupBy("key").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in sides])
    n = {s: F.col(f"n_{s}") for s in sides}
    partial = reduce(lambda a, b: a | b, [c == 0 for c in n.values()])
    repeated = reduce(lambda a, b: a | b, [c > 1 for c in n.values()])
    found = per_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{s}") for s, c in n.items()], F.count_if(partial).alias("n_partial"), F.count_if(repeated).alias("n_repeated"), F.count_if(F.col("key").isNull()).alias("n_null"))
    first = next(iter(sides))
    tests = [*[(f"{s}_count_differs", F.col(f"n_{s}") != F.col(f"n_{first}")) for s in list(sides)[1:]], ("keys_differ", F.col("n_partial") > 0), ("key_repeated", F.col("n_repeated") > 0), ("key_missing", F.col("n_null") > 0)]
    return found.withColumn("issues", F.array_compact(F.array(*[F.when(t, name) for name, t in tests])))


# Tokens of a company's name that do not name it.
IGNORED_TOKENS = ("co", "company", "corp", "corporation", "group", "holdings", "inc", "incorporated", "limited", "llc", "ltd", "plc", "the")


def identity_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*IGNORED_TOKENS))


def employer_matches(companies: DataFrame, company: str, name: str, employers: DataFrame, employer: str, employer_name: str, descriptors: str) -> DataFrame:
    """(company, employer, kind) where the employer's tokens are the company's (equal), or start them and the rest are among its descriptors (prefix).

    Names meet by equality: each company stands under every prefix of its tokens, so no name is compared with one that does not start alike.
    """
    own = companies.select(company, identity_tokens(F.col(name)).alias("tokens"))
    prefixes = exploded(own, F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda k: F.when(k <= F.size("tokens"), k)), "n")
    prefixes = prefixes.select(company, F.array_join(F.slice("tokens", F.lit(1), F.col("n")), " ").alias("key"), F.slice("tokens", F.col("n") + 1, F.size("tokens")).alias("rest"))
    published = employers.select(employer, F.array_join(identity_tokens(F.col(employer_name)), " ").alias("key"), F.coalesce(F.col(descriptors), F.array().cast("array<string>")).alias("terms")).where("key <> ''")
    found = prefixes.join(published, "key").where((F.size("rest") == 0) | (F.size(F.array_except("rest", "terms")) == 0))
    return found.select(company, employer, F.when(F.size("rest") == 0, "equal").otherwise("prefix").alias("kind"))
