"""Connected components of an undirected graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Steps


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, limit: int = 60, step: Steps | None = None) -> DataFrame:
    """(node, component) of every node of an edge; component: the smallest node that links reach. edges: u, v longs; loops and repeats are harmless.

    Each step sums by node with map-side minima and joins a node's minimum back, so a node with very many edges is a skewed join that Spark
    splits, never a group in memory. The steps needed grow with the logarithm of the longest path. step: where the tables go; the last is left to its drop().
    """
    step = step or Steps(edges.sparkSession)
    now = step(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _sum(now)
    for _ in range(limit):
        if not before[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, step(small, "edges")
        step.drop(last)
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {limit} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
