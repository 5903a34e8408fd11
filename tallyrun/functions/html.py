"""Fields of a captured page as column expressions; no document tree is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_LINKS = 200
"""A page yields so many links at most, as its reader's contract says."""


def hrefs(html: Column, most: int = MOST_LINKS) -> Column:
    """The distinct link targets in order of first sight, in any quotes or none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda h: F.regexp_replace(h, r"""^["']|["']$""", ""))), 1, most)


def page_title(html: Column) -> Column:
    """The text of the first ``<title>``, blanks collapsed; empty where there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """The page without scripts, styles, comments and tags, blanks collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
