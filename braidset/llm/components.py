"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidset.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (a, b) with a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    least = least.select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    large = both.join(least, F.col("a") == F.col("_a")).where("b > a and b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    large = large.distinct()
    low = large.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
    small = large.join(low, F.col("a") == F.col("_a")).where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return small.unionAll(low.select(F.col("_a").alias("a"), F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """For every node of edges (a, b) but the least of each component: node, root (its least node).

    Nodes are longs. Every round is written to the shared folder, so lineage stays short and a lost
    executor costs a part of one round. Rounds grow with the logarithm of the longest chain.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(now, "components"), None
    while True:
        # Equal counts and sums of hashes over distinct rows: the same edges.
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, seen = written(_stars(now), "components"), state
