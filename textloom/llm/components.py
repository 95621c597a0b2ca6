"""Connected components by alternating large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond").

Each step is an aggregate (the smallest neighbour) joined back to the edges, so no neighbourhood is ever gathered in one place; Spark
splits the join of a hub. Each round is written to the shared folder, and the loop ends when the edges stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.joins import splittable_join
from textloom.storage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours join the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return splittable_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours join the smallest of these. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = splittable_join(edges, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs in either direction: (node, component), the smallest node each can reach. Loops and repeats are harmless; null ends are ignored."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialise(edges, "cc"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before, old = now, edges.stored_at
        edges = materialise(_small_star(_large_star(edges).distinct()).distinct(), "cc")
        discard(old)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
