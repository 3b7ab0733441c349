"""Connected components of a link table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, component), component = smallest node reachable.

    Every round aggregates neighbour minima with partial sums and joins them back: by broadcast while
    the nodes are few (counted), else by a shuffle in which a node with very many links is a streamed
    key that Spark may split, never a collected group.  Links shrink to stars; a
    round that changes nothing ends the loop.  Each round is checkpointed."""
    e = C.materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        e = C.materialise(_small_star(C.materialise(_large_star(e))))
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", F.col("v").alias("component"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = C.materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    return (C.join_small(both.where("v > u"), low, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour (u > v here)."""
    low = C.materialise(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = C.join_small(e, low, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
