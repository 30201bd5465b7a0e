"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join, so a vertex with very many edges is no hot
group: Spark splits the skewed side of the join. Steps repeat until the stars no longer change,
in practice about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settled

EDGES_A_TASK = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b) that isn't the smallest of its component."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = 1 + edges.count() // EDGES_A_TASK  # a small graph in a few tasks: else each step leaves many tiny files
    now = settled(edges.distinct().coalesce(tasks))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = settled(small.coalesce(tasks).distinct().coalesce(tasks))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = tuple(new)
