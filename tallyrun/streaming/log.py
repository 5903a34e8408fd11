"""An append-only log of JSON lines as a stream, kept durably, counted in windows, and folded into a store of the newest row of each key.

Every run reads what has come since the last one (``availableNow``) and ends; the checkpoint makes each line count once, also after a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import upsert_newest


def log_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """New files of the log; a line that does not parse stops the run."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("mode", "FAILFAST").json(path)


def append_durably(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append all new rows to a Parquet table."""
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(stream: DataFrame, at: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    """Rows by window and keys; rows later than ``late`` do not count, and windows older than that leave the state."""
    found = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), *keys, "n")


def once_within(stream: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key among those that come within ``late`` of each other; older keys leave the state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def fold_newest(stream: DataFrame, key: str, at: str, store: str, checkpoint: str) -> DataFrame:
    """The newest row of each key over all runs.

    A batch writes the store's next version from the last one, so a batch that runs again after a failure gives the same version.
    """
    spark = stream.sparkSession
    schema = stream.schema
    version = lambda n: f"{store}/v={n}"
    done = []

    def fold(rows: DataFrame, n: int) -> None:
        before = spark.read.schema(schema).parquet(version(n - 1)) if n else spark.createDataFrame([], schema)
        upsert_newest(before, rows, key, at).write.mode("overwrite").parquet(version(n))
        done.append(n)

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = done[-1] if done else _last_version(spark, store)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(version(last))


def _last_version(spark: SparkSession, store: str) -> int | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(n.removeprefix("v=")) for n in names if n.startswith("v=")), default=None)
