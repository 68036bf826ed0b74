"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.scratch import discard, join_groups, written


def _smallest_neighbours(both: DataFrame) -> DataFrame:
    """(u, least, degree): the least of u and its neighbours."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("degree"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (u, v).

    Each step replaces a node's links by links to its least neighbour, so every
    component ends as a star.  A node with very many links is split over the
    tasks by the join.  Null ends are dropped; no edges give an empty result.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_smallest_neighbours(both), "least")
        large = join_groups(both, least, "u", "degree").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        down = written(large.where("u <> v").distinct(), "down")
        lower = written(_smallest_neighbours(down), "least")
        small = join_groups(down, lower, "u", "degree")
        old, now = now, written(small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v"))).where("u <> v").distinct(), "edges")
        discard(old, least, down, lower)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
