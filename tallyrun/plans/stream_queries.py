"""Queries over the log as a stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import new_path
from ..streaming import log
from .tables import table

SCHEMA = "event_id long, at timestamp, user_id long, event_type string"


def _log(spark: SparkSession, d: str) -> str:
    """The events as four files of JSON lines."""
    path = new_path(spark, "log")
    rows = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), "user_id", "event_type")
    rows.repartitionByRange(4, "event_id").write.json(path)
    return path


def src09_durable_log(spark: SparkSession, d: str) -> DataFrame:
    path, kept = _log(spark, d), new_path(spark, "kept")
    for _ in range(2):  # the second run finds nothing new
        log.append_durably(log.log_stream(spark, path, SCHEMA, 1), f"{kept}/table", f"{kept}/checkpoint")
    return spark.read.parquet(f"{kept}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def str09_folded_newest(spark: SparkSession, d: str) -> DataFrame:
    path, kept = _log(spark, d), new_path(spark, "newest")
    found = log.fold_newest(log.log_stream(spark, path, SCHEMA, 1), "user_id", "event_id", f"{kept}/store", f"{kept}/checkpoint")
    return found.select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (src09_durable_log, str09_folded_newest)}

ORACLES = {
    "src09_durable_log": "select event_type, count(*) as n, max(event_id) as last from events group by 1",
    "str09_folded_newest": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
}
