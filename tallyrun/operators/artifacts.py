"""Artifacts bound by the digests of their content: file scans with a digest a file, links between manifests, chains with their first broken link, and
an archive of runs keyed by content.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path


def file_digests(spark: SparkSession, path: str | list[str], suffix: str = "", before: str | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """path, name, size and sha256 of the files below some paths: of a suffix, changed before a time, and not named among ``excluded``.

    Name and time are judged on the listing; only files that stay are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    if before:
        reader = reader.option("modifiedBefore", before)
    files = reader.load(path).withColumn("name", F.substring_index("path", "/", -1))
    kept = files.where(~F.col("name").isin(*excluded)) if excluded else files
    return kept.select("path", "name", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tagged_lines(spark: SparkSession, path: str | list[str], files: DataFrame) -> DataFrame:
    """The text lines of several files, each with its file's name and digest (``files`` from ``file_digests``)."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.join(files.select("path", "name", "sha256"), "path").drop("path")


def content_digest(columns: Sequence[str]) -> Column:
    """The sha256 of a row's columns as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def link_states(claims: DataFrame, contents: DataFrame) -> DataFrame:
    """Claims (chain, step, role, target, claimed) with status: bound, mismatch where the target's content has another digest, or missing.

    ``contents`` has target and digest, one row a target.
    """
    found = claims.join(contents.select("target", F.col("digest").alias("actual")), "target", "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual").eqNullSafe(F.col("claimed")), "bound").otherwise("mismatch")
    return found.select("chain", "step", "role", "target", "claimed", "actual", status.alias("status"))


def chain_report(links: DataFrame) -> DataFrame:
    """Per chain: n_links, n_broken, and first_step, first_role and first_status of its first link, by step and role, that is not bound."""
    broken = F.when(F.col("status") != "bound", F.struct("step", "role", "status"))
    found = links.groupBy("chain").agg(F.count("*").alias("n_links"), F.count(broken).alias("n_broken"), F.min(broken).alias("first"))
    return found.select("chain", "n_links", "n_broken", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("step", "role", "status")])


def successor_claims(entries: DataFrame, chain: str, order: Sequence[str], target: str, digest: str) -> DataFrame:
    """The claims of a hash chain: every entry but the first claims the digest of the one before it, as it was when the entry was made."""
    before = Window.partitionBy(chain).orderBy(*order)
    rows = entries.select(F.col(chain).alias("chain"), F.row_number().over(before).alias("step"), F.lag(target).over(before).alias("target"), F.lag(digest).over(before).alias("claimed"))
    return rows.where("step > 1").withColumn("role", F.lit("previous"))


def binding_issues(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of all broken ones in order (``issues``)."""
    names = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("issues", names).where(F.size("issues") > 0)


def run_digests(rows: DataFrame, run: str) -> DataFrame:
    """run and digest of its rows, whatever their order: from counts and sums of two hashes a row, so no run is gathered."""
    columns = [c for c in rows.columns if c != run]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return rows.groupBy(run).agg(F.sha2(F.concat_ws("|", F.count("*"), *sums), 256).alias("digest"))


def archive_runs(rows: DataFrame, run: str, path: str, writer: str) -> DataFrame:
    """Append the runs whose content the archive does not hold yet, and return run, digest and added of all given runs.

    A run's name is no part of its content: of runs with equal rows one is held.

    The archive is a Parquet table partitioned by digest and writer and is only ever appended to.  Two writers that add the same content at
    a time both commit; ``archived`` then reads the first writer's copy, which equals the other.
    """
    spark = rows.sparkSession
    digests = run_digests(rows, run)
    held = _held(spark, path)
    told = digests.withColumn("added", F.lit(True)) if held is None else digests.join(held.select("digest").distinct().withColumn("_held", F.lit(True)), "digest", "left").select(run, "digest", F.col("_held").isNull().alias("added"))
    decided = new_path(spark, "archived")  # before the archive changes
    told.write.parquet(decided)
    told = spark.read.schema(told.schema).parquet(decided)
    new = told.where("added").groupBy("digest").agg(F.min(run).alias(run))
    rows.join(new, run).withColumn("writer", F.lit(writer)).write.mode("append").partitionBy("digest", "writer").parquet(path)
    return told


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path).withColumn("writer", F.col("writer").cast("string")) if there else None


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The archive's rows, of each content one writer's copy."""
    rows = _held(spark, path)
    first = rows.groupBy("digest").agg(F.min("writer").alias("writer"))
    return rows.join(first, ["digest", "writer"]).drop("writer")


def regressions(runs: DataFrame, run: str, order: str, same: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Each run's metrics (one row a run) against the latest earlier run that agrees in the columns ``same``: baseline and ``delta_`` columns, null without one."""
    before = Window.partitionBy(*same).orderBy(order, run)
    return runs.select(run, F.lag(run).over(before).alias("baseline"), *[(F.col(m) - F.lag(m).over(before)).alias(f"delta_{m}") for m in metrics])
