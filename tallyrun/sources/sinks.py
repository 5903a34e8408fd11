"""Results as files and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stores import csv_cell


def csv_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as one CSV line: formulas guarded, quotes doubled where a cell needs them; null cells are empty."""
    cell = lambda c: F.when(csv_cell(F.col(c)).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(csv_cell(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(csv_cell(F.col(c)))
    return rows.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV in part files with CRLF line ends, replaced as a whole by the commit protocol.

    The first part holds the byte-order mark and the header alone, so the parts joined in the order of their names are one CSV, for an empty table too.
    """
    head = rows.sparkSession.range(0, 1, 1, 1).select(F.lit("\ufeff" + ",".join(columns)).alias("line"))
    head.unionByName(csv_lines(rows, columns)).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def markdown_table(title: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    """A heading and a table; a dash for nulls, bars escaped."""
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def markdown_report(title: str, sections: Mapping[str, DataFrame], most_rows: int = 50) -> str:
    """A report of small aggregates, each at most ``most_rows`` long in the order of all its columns, with a note where there were more."""
    parts = [f"# {title}\n"]
    for name, df in sections.items():
        rows = df.orderBy(*df.columns).limit(most_rows + 1).collect()
        parts.append(markdown_table(name, df.columns, rows[:most_rows]) + (f"\nOnly the first {most_rows} rows are shown.\n" if len(rows) > most_rows else ""))
    return "\n".join(parts)


def publish(rows: DataFrame, path: str, policy: str = "replace") -> bool:
    """Write a table as Parquet: ``replace`` overwrites; ``require-identical`` writes where nothing lies and else demands equal rows.  True if it wrote."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if policy == "replace" or not there:
        rows.write.mode("overwrite").parquet(path)
        return True
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())
    before = spark.read.parquet(path)
    if before.dtypes != rows.dtypes or digest(before) != digest(rows):
        raise ValueError(f"other rows lie at {path}")
    return False
