"""Connected components of a distributed graph: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """edges: (u, v) longs.  Returns (node, component) for each node of an edge, component the smallest node reachable.

    Each round hangs every neighbour on its smallest one, so the depth of a component shrinks by a
    constant factor; a round ends as a written table.  Minima are combined before rows are dealt out.  Rounds end when every node
    hangs on its component's smallest: none ends them before.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    i = 0
    while True:
        i += 1
        tops = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if now.select(F.col("v").alias("u")).join(tops, "u", "left_semi").limit(1).isEmpty() and tops.where("n > 1").limit(1).isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = scratch.keep(small.distinct(), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
