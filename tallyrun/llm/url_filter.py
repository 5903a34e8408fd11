"""URL filters: a weighted vocabulary scanned by an Aho-Corasick automaton, over host/path rules.

Host and path are column expressions.  A rule names a host and a path prefix; it fits its host and every
subdomain when the url's path starts with the rule's path, and the longest fitting rule decides.  Urls that
no rule decides go by the vocabulary: one strict term, or ``SOFT_LIMIT`` distinct soft terms, block.
A term counts only between borders, which are the ends of the url and every character but a-z and 0-9.

Nulls, urls without ``://`` and empty urls have empty host and path; the vocabulary still reads the whole
url (null: nothing, so allow).  Rows are judged one by one, so repeats and ties need no rule; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary.  A strict term weighs as much as the limit, a soft one weighs 1.
STRICT_TERMS = ("casino", "escort", "malware", "phishing", "pills", "porn", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "bet", "bonus", "cheap", "click", "deal", "farm", "free", "loan", "offer", "promo", "sale", "tracker", "win")
SOFT_LIMIT = 2
# The rules (action, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MOST_RULES = 2000
"""Rules are folded into one expression; a longer list belongs in a table joined on (host suffix, path prefix)."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(action, rule); null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} go into one expression")
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def vocabulary_hits(strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS):
    """A pandas UDF: url to struct(n_strict, n_soft), the distinct terms of each kind that stand between borders."""
    weights = {t: (1, 0) for t in strict} | {t: (0, 1) for t in soft if t not in strict}
    inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    @F.pandas_udf("n_strict int, n_soft int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()
        lower = str.maketrans(_UPPER, _LOWER)

        def count(url: str | None) -> tuple[int, int]:
            found = set()
            text = (url or "").translate(lower)
            for end, term in automaton.iter(text):
                start = end - len(term)
                if (start < 0 or text[start] not in inner) and (end + 1 == len(text) or text[end + 1] not in inner):
                    found.add(term)
            return sum(weights[t][0] for t in found), sum(weights[t][1] for t in found)

        for part in urls:
            yield pd.DataFrame([count(u) for u in part], columns=["n_strict", "n_soft"], dtype="int32")

    return hits


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft and verdict (allow or block) to every row; columns of these names are replaced."""
    names = ("host", "path", "rule", "n_strict", "n_soft", "verdict")
    kept = [c for c in pages.columns if c not in names]
    found = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url}`").alias("_url")).select(
        "*", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), vocabulary_hits(strict, soft)("_url").alias("_hits")
    )
    by_terms = F.when((F.col("_hits.n_strict") > 0) | (F.col("_hits.n_soft") >= soft_limit), "block").otherwise("allow")
    return found.select(
        "*", rule_of(F.col("host"), F.col("path"), rules).alias("_rule"), by_terms.alias("_by_terms")
    ).select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_rule.rule").alias("rule"),
        F.col("_hits.n_strict").alias("n_strict"), F.col("_hits.n_soft").alias("n_soft"),
        F.coalesce("_rule.action", "_by_terms").alias("verdict"),
    )
