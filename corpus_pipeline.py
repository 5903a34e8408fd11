"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Each stage's result is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrun.llm import decontaminate, minhash, packing, quality_rules, suffix_array
from tallyrun.llm.storage import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_quality(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by a similarity of 0.8 of 5-word shingles."""
    return minhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the stretches of 200 bytes and more that start anywhere else too, their first occurrence included."""
    return suffix_array.drop_repeats(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, one a sequence."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", keep_unleaked),
    ("packing", pack),
]

#: Suffix sorting, verified near-duplicates and tokenising are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, f"stage{k}")
            scratch.clear(docs)
    return docs
