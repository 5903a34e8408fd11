"""Where intermediate tables go: one folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset a new local folder, which only one machine's session may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyrun-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, fixes values that depend on partitioning (row numbers of a range-sorted table),
    and survives the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    """As Parquet; the shuffle files of the write go with it, not with the driver's next collection of garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


class Scratch:
    """The written tables of one operator's run, each deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``."""
        path = new_path(self.spark, name)
        _write(df, path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((found, path))
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Delete these; what was made from them must have been written."""
        self._delete([t for t in self.tables if any(t[0] is x for x in tables)])

    def clear(self, *kept: DataFrame) -> None:
        """Delete all but these."""
        self._delete([t for t in self.tables if not any(t[0] is x for x in kept)])

    def _delete(self, gone: list[tuple[DataFrame, str]]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in gone:
            at = jvm.org.apache.hadoop.fs.Path(table[1])
            at.getFileSystem(conf).delete(at, True)
            self.tables.remove(table)
