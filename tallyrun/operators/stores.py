"""Stores of captures, results, completions and evidence as keyed tables: upserts, expiry, lookups, resume and replay.

Every function takes and returns DataFrames.  ``at`` columns are times or numbers that grow; of rows of one key and time the later frame wins.
Null keys never match; a missing ``at`` is older than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summaries import STAGES

# The statuses that let the next stage run, and those that an export keeps.
PASSED = ("success", "not_applicable")
EXPORT_STATUSES = ("success", "partial", "failed", "unsupported")


def first_cards(rows: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame:
    """The first row of each key in the given order; of these the first ``most``, if given."""
    columns = [c for c in rows.columns if c != key]
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return first.orderBy(order).limit(most) if most is not None else first


def indexed_cards(rows: DataFrame, page: str, order: str, identity: str, per_page: int) -> DataFrame:
    """Rows that have an identity, at most ``per_page`` of a page in order."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(order))
    return rows.filter(F.col(identity).isNotNull()).withColumn("_n", place).filter(F.col("_n") <= per_page).drop("_n")


def fresh(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows no older than so many seconds and not from the future."""
    return rows.filter((F.col(at) <= now) & (F.col(at) >= now - F.expr(f"interval {seconds} seconds")))


def upsert_newest(store: DataFrame, more: DataFrame, key: str, at: str, most: int | None = None) -> DataFrame:
    """One row a key, the newest; ``more`` wins over ``store`` at the same time.  Newest first, the first ``most`` if given."""
    both = store.withColumn("_f", F.lit(0)).unionByName(more.withColumn("_f", F.lit(1))).filter(F.col(key).isNotNull())
    columns = [c for c in store.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, "_f")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return newest.orderBy(F.col(at).desc(), key).limit(most) if most is not None else newest


def with_captured(records: DataFrame, captured: DataFrame, key: str, column: str) -> DataFrame:
    """Records whose ``column`` a capture of the same key replaces where it has a value."""
    own = captured.select(F.col(key).alias("_k"), F.col(column).alias("_c"))
    return records.join(own, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_c", column)).drop("_k", "_c")


def stored_results(store: DataFrame, version: int, at: str, key: str, now: Column, seconds: int, most: int) -> DataFrame:
    """Entries of the schema version that have not expired, newest first, the first ``most``."""
    return fresh(store.filter(F.col("schema_version") == version), at, now, seconds).orderBy(F.col(at).desc(), key).limit(most).drop("schema_version")


def current_results(records: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Results of the records' keys, one a key, from the first source that has one."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    columns = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min(F.struct("source", *[c for c in columns if c != "source"])).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return first.join(records.select(key).distinct(), key, "left_semi")


def result_for(records: DataFrame, results: DataFrame, identity: str, url: str, others: Sequence[str], order: str, value: str) -> DataFrame:
    """Each record (``identity``) with the ``value`` of the first result of the same url, else of the first with the same other columns."""
    by_url = results.filter(F.col(url).isNotNull()).groupBy(url).agg(F.min_by(value, order).alias("_by_url"))
    by_rest = results.groupBy(*others).agg(F.min_by(value, order).alias("_by_rest"))
    found = records.join(by_url, url, "left").join(by_rest, list(others), "left")
    return found.select(identity, F.coalesce("_by_url", "_by_rest").alias(value))


def export_rows(rows: DataFrame, precedence: Mapping[str, tuple[str, ...]], status: str, external: str, error: Mapping[str, str] | None = None) -> DataFrame:
    """A projection where each column is the first of its candidates that is not empty, else empty; and ``result_status``: the pipeline's
    where it is a known one, else external_apply_captured, verification_failed or not_verified.  ``has_result`` tells whether a result was found."""
    first = {name: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit("")) for name, columns in precedence.items()}
    state = F.when(F.col(status).isin(*EXPORT_STATUSES), F.col(status)).when(first[external] != "", "external_apply_captured").when(F.col("has_result"), "verification_failed").otherwise("not_verified")
    return rows.select(*[c.alias(name) for name, c in first.items()], state.alias("result_status"))


def csv_cell(value: Column) -> Column:
    """The value as text that no spreadsheet takes for a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def pending(inputs: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs without a completion."""
    return inputs.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def looked_up(inputs: DataFrame, stored: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Inputs with the newest stored row of their keys; others are left out."""
    columns = [c for c in stored.columns if c not in keys]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*columns), at).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return inputs.join(newest, list(keys))


def invalidated_from(stages: DataFrame, cuts: DataFrame, key: str, order: str) -> DataFrame:
    """Stage rows without those at or after their key's cut (key, ``order``); keys without a cut stay whole."""
    own = cuts.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_cut"))
    return stages.join(own, F.col(key) == F.col("_k"), "left").filter(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_k", "_cut")


def load_evidence(layers: DataFrame, key: str, layer: str, at: str, now: Column, seconds: int, order: Sequence[str]) -> DataFrame:
    """Rows (key, layer, ...) that have not expired and whose key has all earlier layers of ``order`` too."""
    live = fresh(layers, at, now, seconds)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(layer))
    have = live.groupBy(F.col(key).alias("_k")).agg(*[F.max(F.col(layer) == name).alias(f"_{i}") for i, name in enumerate(order)])
    reach = reduce(lambda acc, i: F.when(~F.col(f"_{i}"), i).otherwise(acc), reversed(range(len(order))), F.lit(len(order)))
    reach = have.select("_k", reach.alias("_reach"))
    return live.join(reach, F.col(key) == F.col("_k")).filter(rank <= F.col("_reach")).drop("_k", "_reach")


def merge_evidence(prior: DataFrame, new: DataFrame, key: str, at: str, parent: str, boards: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(parents, boards) after a newer parent layer: it replaces the prior one unless older; boards of a key whose parent changed go, and of
    the others the ``most`` newest stay."""
    old = prior.select(key, F.col(at).alias("_pa"), F.col(parent).alias("_pp"))
    both = old.join(new.select(key, F.col(at).alias("_na"), F.col(parent).alias("_np")), key, "full")
    taken = F.col("_na").isNotNull() & (F.col("_pa").isNull() | (F.col("_na") >= F.col("_pa")))
    parents = both.select(key, F.when(taken, F.col("_na")).otherwise(F.col("_pa")).alias(at), F.when(taken, F.col("_np")).otherwise(F.col("_pp")).alias(parent), (taken & F.col("_pp").isNotNull() & (F.col("_pp") != F.col("_np"))).alias("changed"))
    rest = boards.join(parents.filter("changed").select(key), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), *[c for c in boards.columns if c not in (key, at)]))
    return parents, rest.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def invalidate_layer(layers: DataFrame, gone: DataFrame, key: str, layer: str, order: Sequence[str]) -> DataFrame:
    """Rows without the layers of ``gone`` (key, layer) and those that build on them."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(layer))
    cut = gone.groupBy(F.col(key).alias("_k")).agg(F.min(rank).alias("_cut"))
    return layers.join(cut, F.col(key) == F.col("_k"), "left").filter(F.col("_cut").isNull() | (rank < F.col("_cut"))).drop("_k", "_cut")


def matching(rows: DataFrame, wanted: Mapping[str, Sequence], anything_of: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows whose columns have one of the wanted values, and whose array columns overlap with theirs; empty lists ask for nothing."""
    tests = [F.col(c).isin(*v) for c, v in wanted.items() if v] + [F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) for c, v in (anything_of or {}).items() if v]
    return rows.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def has_source(name: Column, website: Column, apply_url: Column, profile: Column, without_website: bool) -> Column:
    """A name, and a website or a link to apply; or, where that is allowed, a profile."""
    return present(name) & (present(website) | present(apply_url) | (F.lit(without_website) & present(profile)))


def candidates(rows: DataFrame, required: Sequence[str], forbidden: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """The allowed columns of rows that have all required and none of the forbidden values."""
    sound = reduce(lambda a, b: a & b, [present(F.col(c)) for c in required] + [~present(F.col(c)) for c in forbidden])
    return rows.filter(sound).select(*[c for c in allowed if c in rows.columns])


def native_posting(availability: Column, apply_mode: Column, source: Column, trusted: str, url: Column, expected: Column) -> Column:
    """The posting's url where a trusted source says that it is active and applied to natively, and it is the expected one, if any; else null."""
    holds = (F.lower(F.trim(availability)) == "active") & (F.lower(F.trim(apply_mode)) == "linkedin_native") & (source == trusted) & present(url)
    return F.when(holds & (expected.isNull() | (expected == url)), url)


def closed_status(*values: Column) -> Column:
    """The first of the values that says closed or expired, else null."""
    low = [F.lower(F.trim(v)) for v in values]
    return F.coalesce(*[F.when(v.isin("closed", "expired"), v) for v in low])


def resume_decision(pipeline_status: Column, stages: Column, expected: Sequence[str] = STAGES) -> Column:
    """struct(action, reason, retry_stage, reason_code) from an array of struct(stage, status, retryable, reason_code) in order."""
    first = F.get(F.filter(stages, lambda s: ~F.coalesce(s["status"].isin(*PASSED), F.lit(False))), F.lit(0))
    at = F.array_position(F.transform(stages, lambda s: F.coalesce(s["status"].isin(*PASSED), F.lit(False))), False)
    seen = F.when(at > 0, at).otherwise(len(expected)).cast("int")
    names = F.transform(F.slice(stages, F.lit(1), seen), lambda s: s["stage"])
    sound = (F.size(stages) == len(expected)) & names.eqNullSafe(F.slice(F.array(*map(F.lit, expected)), F.lit(1), seen)) & ((at == 0) | first["status"].isNotNull())
    fixed = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("retry_stage"), F.lit(None).cast("string").alias("reason_code"))
    own = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), first["stage"].alias("retry_stage"), first["reason_code"].alias("reason_code"))
    return (
        F.when(pipeline_status == "success", fixed("completion_restore", "pipeline_success"))
        .when(~F.coalesce(sound, F.lit(False)), fixed("unclassified_restore", "invalid_stage_chain"))
        .when(at == 0, fixed("unclassified_restore", "inconsistent_pipeline_status"))
        .when(first["status"] == "not_run", fixed("unclassified_restore", "missing_failure_stage"))
        .when(first["retryable"].isNull(), fixed("unclassified_restore", "missing_retryability"))
        .when(first["retryable"], own("retryable_resubmit", "retryable_stage_failure"))
        .otherwise(own("non_retryable_restore", "non_retryable_stage_outcome"))
    )


def stage_status(stages: Column, stage: str) -> Column:
    """The status of the first entry of a stage, else ``not_run``."""
    return F.coalesce(F.get(F.filter(stages, lambda s: s["stage"] == stage), F.lit(0))["status"], F.lit("not_run"))


def result_records(rows: DataFrame, stages: str, derived: Mapping[str, str]) -> DataFrame:
    """Rows with one status column for each of the derived stages (column name by stage)."""
    return rows.withColumns({column: stage_status(F.col(stages), stage) for stage, column in derived.items()})


def as_json(rows: DataFrame, column: str = "record") -> DataFrame:
    """Each row as one JSON object; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(column))
