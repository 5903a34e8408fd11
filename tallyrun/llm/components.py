"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregate (smallest neighbour of a node) and one join on the node, so a hub's edges may be split
between tasks; the number of rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(arcs).select("u", F.least("u", "m").alias("m"))
    return arcs.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges are (u, v) with u > v."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the smallest node reachable.  Ids are longs.

    The edges of a round are deleted when the next one's are written; the last ones stay in ``scratch``, if given, for its owner to delete.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch(now, "edges")
    seen = _sum(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        step = _small_star(_large_star(now).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()).distinct()
        then = scratch(step, "edges")
        scratch.drop(now)
        state = _sum(then)
        if state == seen:
            now = then
            break
        now, seen = then, state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
