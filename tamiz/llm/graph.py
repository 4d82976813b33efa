"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.store import dropped, saved


def _open(edges: DataFrame) -> bool:
    """Whether some node has two smaller ones, or a smaller and a larger one: else every component is a star of its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v): component is the smallest node it reaches.

    Each step is a groupBy with map-side minima and a join, never a collected neighbour list. The minima are written to
    the shared folder before they are joined, so that both sides of a join come plainly from a shuffle and Spark can split
    the edges of a hub over several tasks. Every round is written too. Loops, repeated edges and nulls are allowed; an
    edge with a null end is ignored. Without edges the result is empty.
    """
    now = saved(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        after = saved(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        for used in (now, least, large, low):
            dropped(used)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
