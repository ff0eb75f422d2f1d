"""Connected components of links that stay distributed: alternating large and small stars.

Each round rewires every vertex to the smallest vertex that it or a neighbour knows, until
nothing moves. A vertex with very many links is no group in memory: its smallest neighbour
is a pre-aggregated minimum, and its links meet that minimum in a plain join whose large
partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folders, materialise, scratch


def components(links: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex of links (a, b): the smallest vertex that it reaches.

    Vertices are longs; loops and repeated links change nothing; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before, old = materialise(edges, "links"), None, []
    while True:
        with scratch() as now:
            edges = _round(edges)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_folders(links.sparkSession, old + now.folders[:-1])
        old = now.folders[-1:]
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small one. Minima are written before they are joined, so that the join of a hub's links is split."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    large = both.join(least.hint("merge"), F.col("u") == F.col("w")).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # A vertex larger than all its neighbours hands none of them on in the large star; it stays tied by the small one.
    large = materialise(large, "large-star")
    least = materialise(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
    small = large.join(least.hint("merge"), F.col("u") == F.col("w")).select("u", "v", "m")
    small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
    return materialise(small, "small-star")
