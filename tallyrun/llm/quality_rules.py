"""Quality rules: a short-circuit cascade of SQL predicates, ordered by rejection per cost.

Every measure is one Spark SQL expression over the whole text, so nothing leaves the JVM and nothing is shuffled.
``fit_cascade`` times each rule and counts on a bounded sample what it rejects of the rows that the rules before it leave;
``verdict`` then chains the rules in a CASE, so that a dear rule is not evaluated for texts that a cheap one has rejected.
The order changes the cost, never the verdict: a text is kept when no rule rejects it.

A null text counts as empty; empty texts have no words and fail ``too_short``.  Very long texts are read whole.
Rows are judged one by one: ties and repeats need no rule, an empty table gives an empty result, and extra columns pass
(those named like an output of the operator are replaced).
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 256
"""How many rows the order of the rules is fitted on: the first of the table, since a spread sample would read it all."""
TIMED_RUNS = 3
"""A rule's cost is the least time of so many runs over the sample, after one that compiles it."""
WINDOW = 8
"""Words in the windows that ``n_repeat_words`` looks for."""

_TEXT = "coalesce({text}, '')"
WORDS = r"filter(split(" + _TEXT + r", r'[\x20\x09-\x0D]+'), w -> w != '')"
_LET = "transform(array({value}), {name} -> {body})[0]"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return _LET.format(name=name, value=value, body=body)


def _repeat_words(window: int = WINDOW) -> str:
    """Words covered by windows found twice or more, by 64-bit hashes of the windows.

    Texts without a repeated window, by far the most, end after one distinct count.  Else the starts of repeated
    windows are sorted and the union of [start, start + window) is summed up in one fold.
    """
    hashes = f"transform(sequence(0, size(w) - {window}), i -> xxhash64(" + ", ".join(f"w[i + {k}]" for k in range(window)) + "))"
    pairs = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i)))"
    starts = "sort_array(filter(transform(s, (x, k) -> if(x.h = get(s, k - 1).h or x.h = get(s, k + 1).h, x.p, null)), p -> p is not null))"
    covered = (
        f"aggregate({starts}, named_struct('last', cast({-window} as int), 'n', 0L),"
        f" (a, p) -> named_struct('last', p, 'n', a.n + least({window}, p - a.last)), a -> a.n)"
    )
    body = f"if(size(array_distinct(h)) = size(h), 0L, {_let('s', pairs, covered)})"
    return f"if(size(w) < {window + 1}, 0L, {_let('h', hashes, body)})"


def _dup_lines(body: str = "cast(size(l) - size(array_distinct(l)) as bigint)") -> str:
    return _let("l", r"filter(split(" + _TEXT + r", '\n'), x -> x rlike r'[^\x20\x09-\x0D]')", body)


def _lines_like(pattern: str) -> str:
    return "cast(size(filter(split(" + _TEXT + r", '\n'), x -> x rlike r'" + pattern + "')) as bigint)"


# Patterns of lines and words, alike in Java's and DuckDB's regular expressions.
BULLET_LINE = r"^[ \t]*[-*\x{2022}]"
ELLIPSIS_LINE = r"(\.\.\.|\x{2026})[ \t\r]*\z"
LETTERLESS_WORD = r"^[\x00-\x40\x5B-\x60\x7B-\x7F]+\z"

#: Measures by name, as SQL over ``{text}``.
MEASURES = {
    "n_words": f"cast(size({WORDS}) as bigint)",
    "word_chars": r"cast(length(translate(" + _TEXT + r", ' \t\n\u000B\f\r', '')) as bigint)".replace(r"\f", r"\u000C"),
    "n_symbols": "cast(length(" + _TEXT + ") - length(translate(" + _TEXT + ", '#*$%&|<>', '')) as bigint)",
    "n_lines": _dup_lines("cast(size(l) as bigint)"),
    "n_dup_lines": _dup_lines(),
    "n_repeat_words": _let("w", WORDS, _repeat_words()),
}
#: Measures that only rules read; no column shows them, so they are evaluated on the rows that reach their rule.
LAZY_MEASURES = {
    "n_bullets": _lines_like(BULLET_LINE.replace("{", "{{").replace("}", "}}")),
    "n_ellipses": _lines_like(ELLIPSIS_LINE.replace("{", "{{").replace("}", "}}")),
    "n_letterless": "cast(size(filter(" + WORDS + ", x -> x rlike r'" + LETTERLESS_WORD + "')) as bigint)",
}


@dataclass(frozen=True)
class Rule:
    """A rejection in SQL over measures, written ``{n_words}`` and so on."""

    name: str
    rejects: str

    def sql(self, text: str, ready: Sequence[str] = ()) -> str:
        """The rejection over ``text``; the measures named in ``ready`` are columns already."""
        found = {k: k if k in ready else v.format(text=text) for k, v in (MEASURES | LAZY_MEASURES).items()}
        return self.rejects.format(**found)

    def reads(self) -> set[str]:
        return set(re.findall(r"\{(\w+)\}", self.rejects))


BASE_RULES = (Rule("too_short", "{n_words} < 20"), Rule("repeats", "100 * {n_repeat_words} > 30 * {n_words}"))
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 15 * {n_words}"),
    Rule("dup_lines", "{n_lines} >= 5 and 100 * {n_dup_lines} > 60 * {n_lines}"),
    Rule("bullets", "{n_lines} >= 5 and 10 * {n_bullets} > 9 * {n_lines}"),
    Rule("ellipses", "{n_lines} >= 5 and 10 * {n_ellipses} > 3 * {n_lines}"),
    Rule("letterless", "100 * {n_letterless} > 40 * {n_words}"),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add every measure of ``MEASURES`` as a bigint column."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    return docs.select(*kept, *[F.expr(sql.format(text=f"`{text}`")).alias(name) for name, sql in MEASURES.items()])


def fit_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, placed: Sequence[Rule] = ()
) -> list[Rule]:
    """The rules, each the one that rejects most a second of the sampled rows that ``placed`` and the rules before it leave.

    Without rejections left, cheap rules go first.  A rule's seconds are those of its job less those of one that only reads.
    """
    sample = docs.select(F.col(f"`{text}`").alias("text")).limit(sample_rows).repartition(1).cache()

    def seconds(rejects: str) -> float:
        job, times = sample.agg(F.count_if(F.expr(rejects))), []
        for _ in range(1 + TIMED_RUNS):
            began = time.perf_counter()
            job.collect()
            times.append(time.perf_counter() - began)
        return min(times[1:])

    try:
        sample.count()
        reading = seconds("length(text) < 0")
        cost = {r.name: max(1e-4, seconds(r.sql("text")) - reading) for r in rules}
        # One row a sampled text: which rules reject it.
        rejected = sample.select(*[F.coalesce(F.expr(r.sql("text")), F.lit(False)).alias(r.name) for r in (*placed, *rules)]).collect()
    finally:
        sample.unpersist()
    alive = [x for x in rejected if not any(x[r.name] for r in placed)]
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda r: (sum(x[r.name] for x in alive) / cost[r.name], -cost[r.name], r.name))
        order.append(best)
        left.remove(best)
        alive = [x for x in alive if not x[best.name]]
    return order


def verdict(rules: Sequence[Rule], text: str = "text", ready: Sequence[str] = ()) -> Column:
    """The name of the first rule in this order that rejects the text, else null."""
    if not rules:
        return F.lit(None).cast("string")
    return F.expr("case " + " ".join(f"when {r.sql(f'`{text}`', ready)} then '{r.name}'" for r in rules) + " end")


def filter_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Only the rows that no rule rejects, evaluated as a fitted cascade; columns stay as they are."""
    return docs.filter(verdict(fit_cascade(docs, rules, text), text).isNull())


def judge_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``MEASURES``, base_failed (a base rule rejects) and kept (none of ``rules`` does).

    Rules over these measures alone cost nothing more and come first; the others follow as a fitted cascade and are
    evaluated only for rows that are left.
    """
    found = measure(docs.drop("base_failed", "kept"), text)
    free = [r for r in rules if r.reads() <= set(MEASURES)]
    cascade = free + fit_cascade(docs, [r for r in rules if r not in free], text, placed=free)
    base = F.expr(" or ".join(f"({r.sql(text, tuple(MEASURES))})" for r in BASE_RULES))
    return found.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(cascade, text, tuple(MEASURES)).isNull())
