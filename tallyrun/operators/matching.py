"""Joins with checked keys, rule joins, set comparisons and audits between runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 10_000


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty when the key is unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """Full outer join by key with ``side``: both, left_only or right_only; callers require that only ``both`` occurs."""
    a = left.select(*keys, *left_columns).withColumn("_l", F.lit(True))
    b = right.select(*keys, *right_columns).withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, list(keys), "full").withColumn("side", side).drop("_l", "_r")


def join_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: matched pairs, distinct keys only on the left and only on the right, and keys that repeat on the right."""
    a = left.groupBy(F.col(left_key).alias("k")).agg(F.count("*").alias("l"))
    b = right.groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("r"))
    both = a.join(b, "k", "full")
    return both.agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("matched"), F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("r") > 1).alias("right_repeated"),
    )


def annotated(results: DataFrame, annotations: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined, unannotated results, annotations without a result)."""
    return annotations.join(results, list(keys)), results.join(annotations, list(keys), "left_anti"), annotations.join(results, list(keys), "left_anti")


def drift(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, change (added, removed, changed) and the names of changed columns in order; unchanged keys are left out."""
    a, b = before.select(key, F.struct(*columns).alias("a")), after.select(key, F.struct(*columns).alias("b"))
    names = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns]), lambda x: x.isNotNull())
    found = a.join(b, key, "full").withColumn("change", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(names) > 0, "changed"))
    return found.filter("change is not null").select(key, "change", F.when(F.col("change") == "changed", names).otherwise(F.array().cast("array<string>")).alias("fields"))


def excluding(candidates: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that share none of the key columns' values with the history; a null key excludes nothing."""
    return reduce(lambda df, k: df.join(history.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, candidates)


MOST_SENT = 200_000
"""Passage hashes that go to every task; more of them are joined by a shuffle."""
SHORT_BLOCK = 500


def mentions(texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, words: int = 4) -> DataFrame:
    """Pairs (text, passage) where the text contains the passage, each pair of ids once, null ids included.

    The inner words of a passage (all but the first and last, at most ``words``) must stand in a row in the text, so texts and passages meet
    on a hash of such a run, one length at a time, and ``contains`` decides.  The hashes are broadcast only where there are few.
    Passages of one or two words have no inner words; they are a query set that meets all texts in blocks of ``SHORT_BLOCK``.
    """
    split = lambda c: F.split(c, " ")
    p = passages.select(F.col(passage_id), F.col(passage).alias("_p"), split(passage).alias("_w")).filter(F.length("_p") > 0)
    p = p.withColumn("_n", F.least(F.size("_w") - 2, F.lit(words)))
    sizes = {r["_n"]: r["n"] for r in p.groupBy(F.greatest("_n", F.lit(0)).alias("_n")).agg(F.count("*").alias("n")).collect()}
    t = texts.select(F.col(text_id), F.col(text).alias("_t"))
    found = t.join(p, F.lit(False)).select(text_id, passage_id) if not sizes else None
    for n in sorted(sizes.keys() - {0}):
        # a lambda's variable is split once; the expression itself would be split again for every run
        runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n))))  # noqa: B023, E731
        hashed = F.get(F.transform(F.array(split("_t")), runs), F.lit(0))
        inner = p.filter(F.col("_n") == n).withColumn("_h", F.xxhash64(F.slice("_w", 2, n))).select(passage_id, "_p", "_h")
        keys = inner.select(passage_id, "_h")
        seeds = t.select(text_id, F.explode(hashed).alias("_h")).join(F.broadcast(keys) if sizes[n] <= MOST_SENT else keys, "_h").select(text_id, passage_id).distinct()
        both = seeds.join(t.withColumnRenamed(text_id, "_i"), F.col(text_id).eqNullSafe(F.col("_i"))).join(inner.select(F.col(passage_id).alias("_k"), "_p"), F.col(passage_id).eqNullSafe(F.col("_k")))
        pairs = both.filter(F.contains("_t", "_p")).select(text_id, passage_id).distinct()
        found = pairs if found is None else found.unionByName(pairs)
    blocks = -(-sizes.get(0, 0) // SHORT_BLOCK)
    for k in range(blocks):
        own = p.filter((F.col("_n") <= 0) & (F.pmod(F.xxhash64(passage_id, "_p"), F.lit(blocks)) == k)).select(passage_id, "_p")
        pairs = t.join(F.broadcast(own), F.contains("_t", "_p")).select(text_id, passage_id).distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def first_rule(rows: DataFrame, column: str, rules: Sequence[tuple[str, str, str]], default: str | None = None) -> Column:
    """The label of the first rule (kind, pattern, label) that fits; kinds: equals, prefix, suffix, contains, token, regex."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    c = F.col(column)
    tests = {
        "equals": lambda p: c == p, "prefix": lambda p: c.startswith(p), "suffix": lambda p: c.endswith(p), "contains": lambda p: c.contains(p),
        "token": lambda p: F.array_contains(F.split(F.lower(c), "[^a-z0-9]+"), p), "regex": lambda p: c.rlike(p),
    }
    out = reduce(lambda acc, r: acc.when(tests[r[0]](r[1]), r[2]), rules, F.when(F.lit(False), ""))
    return out.otherwise(F.lit(default)) if default is not None else out


def lookup(rows: DataFrame, registry: DataFrame, keys: Sequence[str], value: str, limit: int) -> DataFrame:
    """Rows with status (found, not_found, ambiguous for more than ``limit``) and the sorted values found."""
    found = registry.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    out = rows.join(found, list(keys), "left")
    n = F.coalesce(F.size("values"), F.lit(0))
    n = F.when(F.col("values").isNull(), 0).otherwise(n)
    return out.withColumn("status", F.when(n == 0, "not_found").when(n > limit, "ambiguous").otherwise("found")).withColumn("values", F.when((n > 0) & (n <= limit), F.col("values")))


def consume_once(requests: DataFrame, entries: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The nth request of a key with its nth entry: request_order, entry_order; either null where the other side has none."""
    n = lambda df, name: df.select(*key, F.col(order).alias(name), F.row_number().over(Window.partitionBy(*key).orderBy(order)).alias("n"))
    return n(requests, "request_order").join(n(entries, "entry_order"), [*key, "n"], "full")


def positional_compare(source: DataFrame, replay: DataFrame, scope: str, position: str, value: str) -> DataFrame:
    """scope, position and class: reproduced, mismatch, missing_in_replay, extra_in_replay or divergence (a mismatch after one)."""
    a, b = source.select(scope, position, F.col(value).alias("a"), F.lit(True).alias("_a")), replay.select(scope, position, F.col(value).alias("b"), F.lit(True).alias("_b"))
    rows = a.join(b, [scope, position], "full")
    kind = F.when(F.col("_b").isNull(), "missing_in_replay").when(F.col("_a").isNull(), "extra_in_replay").when(F.col("a").eqNullSafe(F.col("b")), "reproduced").otherwise("mismatch")
    rows = rows.withColumn("class", kind)
    earlier = F.max(F.col("class") == "mismatch").over(Window.partitionBy(scope).orderBy(position).rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(scope, position, F.when((F.col("class") == "mismatch") & F.coalesce(earlier, F.lit(False)), "divergence").otherwise(F.col("class")).alias("class"))


def in_scopes(log: DataFrame, scopes: DataFrame) -> DataFrame:
    """Log rows (scope_id, sequence) within their scope's first to last sequence."""
    inside = (F.col("l.sequence") >= F.col("s.first")) & (F.col("l.sequence") <= F.col("s.last"))
    return log.alias("l").join(scopes.alias("s"), (F.col("l.scope_id") == F.col("s.scope_id")) & inside).select("l.*")


def tagged_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in frames.items()])


def first_of_union(frames: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """UNION where the first row of a key wins, by frame, then ``order``."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("frame", F.lit(i)) for i, df in enumerate(frames)])
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("frame", order))).filter("_r = 1").drop("_r")


def set_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: added, removed and common distinct keys."""
    a, b = before.select(key).distinct().withColumn("a", F.lit(1)), after.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))


def all_covered(required: DataFrame, portfolio: DataFrame, keys: Sequence[str], complete: str) -> DataFrame:
    """Required keys that occur in no complete portfolio; empty means covered."""
    return required.join(portfolio.filter(F.col(complete)), list(keys), "left_anti")


def count_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before, after, delta over the union of keys, missing as 0."""
    a, b = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((before, "before"), (after, "after")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, key, "full").select(key, zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"))


def compatible(a: str, b: str, fields: Sequence[str]) -> Column:
    """Null-safe equality of all fields of two aliases."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in fields])


def expectation_failures(checks: Mapping[str, tuple[Column, Column]]) -> Column:
    """Names of checks whose expected value is given and differs from the actual one, in order."""
    tests = [F.when(exp.isNotNull() & ~F.coalesce(exp == act, F.lit(False)), name) for name, (exp, act) in checks.items()]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def alias_failures(rows: DataFrame, checks: Mapping[str, tuple[str, str]], name: str = "failures") -> DataFrame:
    """The rows with the names of failed checks; an expected column that is an array holds all values that count as right, its nulls none."""
    kinds = dict(rows.dtypes)
    same = lambda e, a: F.array_contains(F.array_compact(F.col(e)), F.col(a)) if kinds[e].startswith("array<") else F.col(e) == F.col(a)
    tests = [F.when(F.col(e).isNotNull() & ~F.coalesce(same(e, a), F.lit(False)), c) for c, (e, a) in checks.items()]
    return rows.withColumn(name, F.filter(F.array(*tests), lambda x: x.isNotNull()))


def identity_chain(row: Mapping[str, Column]) -> Column:
    """Failure codes of an identity chain in fixed order; empty when the chain holds or there is no opening at all.

    ``row`` has hiring_entity, hiring_verified, provider_entity, provider, provider_tenant, provider_board, provider_verified, provider_evidence,
    opening_entity, opening_provider, opening_tenant, opening_board, opening_url and selected_url.
    """
    g = row.__getitem__
    differs = lambda a, b: g(a).isNotNull() & g(b).isNotNull() & (F.lower(g(a)) != F.lower(g(b)))
    rules = [
        ("HIRING_IDENTITY_MISSING", g("hiring_entity").isNull()),
        ("HIRING_RELATIONSHIP_UNVERIFIED", ~F.coalesce(g("hiring_verified"), F.lit(False))),
        ("PROVIDER_IDENTITY_MISSING", g("provider").isNull()),
        ("PROVIDER_RELATIONSHIP_UNVERIFIED", ~F.coalesce(g("provider_verified"), F.lit(False))),
        ("PROVIDER_RELATIONSHIP_PROVENANCE_MISSING", g("provider_evidence").isNull()),
        ("OPENING_IDENTITY_MISSING", g("opening_provider").isNull()),
        ("HIRING_PROVIDER_ENTITY_MISMATCH", differs("hiring_entity", "provider_entity")),
        ("PROVIDER_OPENING_ENTITY_MISMATCH", differs("provider_entity", "opening_entity")),
        ("OPENING_PROVIDER_MISMATCH", differs("provider", "opening_provider")),
        ("OPENING_TENANT_MISMATCH", differs("provider_tenant", "opening_tenant")),
        ("OPENING_BOARD_MISMATCH", differs("provider_board", "opening_board")),
        ("OPENING_URL_INVALID", g("opening_url").isNotNull() & ~g("opening_url").rlike(r"^https?://[^/\s]+")),
        ("OPENING_URL_MISMATCH", differs("opening_url", "selected_url")),
    ]
    codes = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), c) for c, t in rules]), lambda x: x.isNotNull())
    return F.when(g("opening_url").isNull() & g("selected_url").isNull(), F.array().cast("array<string>")).otherwise(codes)


def verdict(codes: Column, has_opening: Column, evaluated: Column) -> Column:
    """not_applicable without an opening, unavailable when not evaluated, verified without failure codes, else rejected."""
    return F.when(~has_opening, "not_applicable").when(~evaluated, "unavailable").when(F.size(codes) == 0, "verified").otherwise("rejected")


def reconciled(counts: Mapping[str, DataFrame]) -> DataFrame:
    """step, n and matches (equal to the first step's count)."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("ord"), F.lit(name).alias("step"), "n") for i, (name, df) in enumerate(counts.items())])
    return rows.withColumn("matches", F.col("n") == F.first("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # a row a step
