"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circlet.llm.common import discard, staged


def are_stars(edges: DataFrame) -> bool:
    """Whether each of the distinct edges(hi, lo) leads to its component's smallest node: no node is hi twice, or both hi and lo."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b: long) -> (node, component) for every node that isn't its component's smallest; edges may repeat.

    Each round joins the edges with one aggregated row per node, so a node of very many edges is pre-aggregated
    and its join side can be split; nothing is collected. The number of rounds grows with the logarithm of the size;
    edges that are stars around their smallest nodes already need none.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not are_stars(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(large.where("hi <> lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = staged(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        discard(large)
        discard(now)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
