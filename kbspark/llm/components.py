"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a group-by minimum and a join on the vertex, both of which Spark pre-aggregates or
splits when one vertex has many edges. Every round is checkpointed, so a lost executor costs one
round. The number of rounds grows with the logarithm of the number of vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or smaller (small star) neighbours of each vertex to its least."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (u long, v long): component is its least vertex."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = materialize(_star(_star(now, True), False))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    # every edge now leads from a vertex to its component's least one
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
