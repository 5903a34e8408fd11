"""Costly steps over small files are dealt out to all tasks, and work nothing out twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyrun.functions import privacy


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["ext07_job_postings", "ext19_organizations", "fn27_places", "fn64_job_records", "cmp05_continuity_issues", "src_boards_postings", "src_boards_inventory"])
def test_spread(spark, sf, name):
    assert f"Repartition {spark.conf.get('spark.sql.shuffle.partitions')}, true" in optimized(__spark_entry__.queries()[name](spark, sf))


def test_redaction_once(spark):
    plan = optimized(spark.createDataFrame([("a",)], "text string").select(privacy.redact_body(F.col("text")).alias("r")))
    once = optimized(spark.createDataFrame([("a",)], "text string").select(privacy.redact_fields(F.col("text")).alias("r"))).count("sessionJWT")
    assert plan.count("sessionJWT") == 2 * once  # once where state is a place, once where it is not
