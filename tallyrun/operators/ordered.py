"""Ordered operators: strongest-per-key, reserved and round-robin selection, folds, backoff, page walks, prefixes.

Ties are broken by every column that is named in the order, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import shared_table


def strongest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def top_ranked(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with position from 1 and truncated (whether there were more).

    One sort-limit over the table; only its ``limit`` + 1 rows are numbered.
    """
    few = df.orderBy(*order).limit(limit + 1)
    numbered = few.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.filter(F.col("position") <= limit)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= limit)


def round_robin(df: DataFrame, bucket: str, order: Sequence[Column], limit: int, buckets: Sequence[Column] | None = None) -> DataFrame:
    """Rows taken one from each bucket in turn.  Only the first ``limit`` of a bucket can be taken, so the rest is cut first."""
    few = df.withColumn("bucket_rank", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("bucket_rank") <= limit)
    return top_ranked(few, ["bucket_rank", *(buckets or [F.col(bucket)]), *order], limit)


def reserved_top(df: DataFrame, source: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The best row of every source first, then the best others up to ``limit``; in the end in ``order``."""
    few = top_per_group(df, [source], order, limit).withColumn("reserved", F.col("position") == 1).drop("position")
    chosen = top_ranked(few, [F.desc("reserved"), *order], limit).drop("position")
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def merged_routes(df: DataFrame, identity: str, route: str, order: Sequence[Column], limit: int) -> DataFrame:
    """One representative an identity, the best identity of each route reserved, filled up to ``limit``; with all its routes."""
    routes = df.groupBy(F.col(identity).alias("_i")).agg(F.array_sort(F.collect_set(route)).alias("routes"))
    best = strongest_per_key(df, [identity], order)
    holds = strongest_per_key(df, [identity, route], order)
    reserved = strongest_per_key(holds, [route], order).select(F.col(identity).alias("_i")).distinct().withColumn("reserved", F.lit(True))
    rows = best.withColumn("_i", F.col(identity)).join(routes, "_i").join(reserved, "_i", "left").withColumn("reserved", F.coalesce("reserved", F.lit(False))).drop("_i")
    return top_ranked(rows, [F.desc("reserved"), *order], limit)


def family_slots(df: DataFrame, tier: str, family: str, order: Sequence[Column]) -> DataFrame:
    """Within tier and family the first is the representative, the others aliases that come after all representatives."""
    w = Window.partitionBy(tier, family).orderBy(*order)
    return df.withColumn("alias", F.row_number().over(w) > 1)


def greedy_quota(df: DataFrame, quotas: Sequence[tuple[str, int]], lane: str, order: Sequence[Column], unique: Sequence[str]) -> DataFrame:
    """Quota by quota, rows in order that repeat no value of any ``unique`` column already taken, as many as the quota says.

    Each quota is bounded, so is what the driver holds: the head of the rows that are still free, twice the quota, is gone through in
    order, and the head is drawn anew until the quota is met or no row is free.  A null repeats nothing.
    """
    taken: dict[str, set] = {u: set() for u in unique}
    chosen = []
    for number, (name, quota) in enumerate(quotas):
        position, most, free = 0, 2 * quota + 8, Counter()
        while position < quota:
            rows = df.filter(F.col(lane) == name)
            for u in unique:
                rows = rows.filter(F.col(u).isNull() | ~F.col(u).isin(*taken[u])) if taken[u] else rows
            head, before, again = rows.orderBy(*order).limit(most).collect(), position, free.copy()
            for row in head:
                own = [row[u] for u in unique if row[u] is not None]
                if not own and again[repr(row)]:  # taken in an earlier draw; no value keeps it out of this one
                    again[repr(row)] -= 1
                elif position < quota and not any(row[u] in taken[u] for u in unique):
                    position += 1
                    chosen.append((*row, position, number))
                    free[repr(row)] += not own
                    for u in unique:
                        taken[u] |= {row[u]} - {None}
            if position == before or len(head) < most:
                break
    return df.sparkSession.createDataFrame(chosen, StructType([*df.schema.fields, StructField("position", IntegerType()), StructField("quota", IntegerType())]))


def first_seen(df: DataFrame, key: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """The first row of each key, numbered by first appearance; at most ``limit`` if given."""
    first = strongest_per_key(df, [key], order)
    if limit is not None:
        return top_ranked(first, order, limit).drop("truncated").withColumnRenamed("position", "ordinal")
    return numbered(first, order, "ordinal")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """A total number from 1 in ``order`` over any number of rows: range partitions, their sizes summed up, and a number within each.

    The sorted rows are written to the shared folder first, so borders and places within a partition stay as they are when executors are lost.
    """
    parts = shared_table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_least"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return parts.join(F.broadcast(sizes.drop("n")), "_p").withColumn(name, F.col("_m") - F.col("_least") + F.col("_before") + 1).drop("_p", "_m", "_least", "_before")


def durable_fold(events: DataFrame, key: str, ordinal: str, outcome: str, accepted: str) -> DataFrame:
    """The durable outcome of each key over its events in order.

    The first sets it; later an accepted one overrides, an unresolved one replaces only an unresolved one, and anything else is ignored.
    """
    row = F.struct(F.col(ordinal).alias("o"), F.col(outcome).alias("v"), F.col(accepted).alias("a"))
    # the last accepted one or the first; after it only unresolved ones count, and only if it is unresolved itself
    found = events.groupBy(key).agg(F.min(row).alias("_f"), F.max(F.when(F.col(accepted), row)).alias("_a"), F.max(F.when(F.col(outcome) == "unresolved", row)).alias("_u"), F.count("*").alias("_n"))
    found = found.withColumn("_b", F.coalesce("_a", "_f"))
    last = F.when(F.col("_b.v") == "unresolved", F.greatest("_b", "_u")).otherwise(F.col("_b"))
    return found.select(key, last["v"].alias("outcome"), last["o"].alias("ordinal"), (F.col("_n") - 1).cast("int").alias("later"))


def backoff(attempt: Column, uniform: Column, base: float = 0.25, factor: float = 2.0, most: float = 8.0, ratio: float = 0.25) -> Column:
    """min(most, base factor^attempt), times 1 + ratio (2 u - 1)."""
    return F.least(F.lit(most), base * F.pow(F.lit(factor), attempt)) * (1 + ratio * (2 * uniform - 1))


def page_walk(pages: DataFrame, key: str, page: str, next_page: str, items: str, item_key: str, most_pages: int) -> DataFrame:
    """Per listing: pages read in order until a repeated or missing next page or the cap; distinct items and the stop reason."""
    w = Window.partitionBy(key).orderBy(page)
    walked = pages.withColumn("_n", F.row_number().over(w)).withColumn("_seen", F.collect_set(next_page).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    walked = walked.withColumn("_cycle", F.array_contains("_seen", F.col(next_page)) | (F.col(next_page) == F.col(page)))
    stops = walked.withColumn("_stop", F.when(F.coalesce("_cycle", F.lit(False)), "cycle").when(F.col(next_page).isNull(), "end").when(F.col("_n") >= most_pages, "cap"))
    until = stops.withColumn("_before", F.count("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("_before = 0")
    rows = until.select(key, "_n", "_stop", F.explode_outer(items).alias("item"))
    return rows.groupBy(key).agg(F.max("_n").alias("pages"), F.countDistinct(F.col("item").getField(item_key)).alias("items"), F.coalesce(F.max("_stop"), F.lit("exhausted")).alias("stop"))


def unique_best(df: DataFrame, key: str, score: str, value: str, shown: int = 8) -> DataFrame:
    """The best value where one is alone at the top, else ambiguous with the first ``shown`` of those that tie."""
    top = df.withColumn("_t", F.max(score).over(Window.partitionBy(key))).filter(F.col(score) == F.col("_t")).select(key, score, value).distinct()
    found = top.groupBy(key, score).agg(F.count("*").alias("n"), F.min(value).alias("one"), F.slice(F.array_sort(F.collect_list(value)), 1, shown).alias("ties"))
    return found.select(key, score, F.when(F.col("n") == 1, F.col("one")).alias("best"), (F.col("n") > 1).alias("ambiguous"), F.when(F.col("n") > 1, F.col("ties")).alias("ties"))


def latest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As-of: each row with columns of the row before it among those of equal ``keys``, as ``previous_<column>``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def first_event(df: DataFrame, key: str, order: Sequence[Column], test: Column) -> DataFrame:
    return strongest_per_key(df.filter(test), [key], order)


def valid_prefix(df: DataFrame, key: str, order: Sequence[str], valid: Column) -> DataFrame:
    """Per key the length of the longest prefix whose rows are all valid, the row count, and whether all are."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_bad", F.sum(F.when(F.coalesce(valid, F.lit(False)), 0).otherwise(1)).over(w))
    found = rows.groupBy(key).agg(F.count_if(F.col("_bad") == 0).alias("prefix"), F.count("*").alias("n"))
    return found.withColumn("complete", F.col("prefix") == F.col("n"))


def distinct_casefold(values: Column) -> Column:
    """An array's elements once each, compared in lower case, the first spelling kept, in order."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(F.transform(values, lambda v, i: F.when(F.array_position(low, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())


def priority_union(frames: Sequence[DataFrame], key: str, text: str, limit: int, group_by: str) -> DataFrame:
    """Groups in order of priority, one row a key, blank text filled from the first other that has some, at most ``limit`` a group."""
    rows = None
    for i, f in enumerate(frames):
        f = f.withColumn("_g", F.lit(i))
        rows = f if rows is None else rows.unionByName(f)
    w = Window.partitionBy(group_by, key).orderBy("_g", "ord")
    filled = F.first(F.when(F.trim(text) != "", F.col(text)), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = rows.withColumn("_t", filled).withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumn(text, F.coalesce("_t", text)).drop("_t", "_r")
    return top_per_group(first, [group_by], ["_g", "ord"], limit).withColumnRenamed("_g", "priority")


def scored_sorted(df: DataFrame, score: str, second: str, threshold: int, ordinal: str) -> DataFrame:
    """Rows at or above the threshold, best first, ties as they came."""
    return df.filter(F.col(score) >= threshold).orderBy(F.desc(score), F.desc(second), ordinal)
