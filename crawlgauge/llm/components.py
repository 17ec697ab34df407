"""Connected components by alternating large and small stars, one pair of shuffles each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each id of the links (a, b): component is the smallest id reachable.

    Each round replaces links by links to smaller ids until only stars are left. The
    minimum of a node's neighbours is aggregated and stored before it is joined back: both
    sides of the join are then plain shuffles, so adaptive execution splits the partition
    of a node with very many links. Rounds are written to the shared folder. Rounds grow
    with the logarithm of the longest path; links that still change after max_rounds (paths
    far beyond 2**20 links) raise an error, and nothing is lost silently.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = stored(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m")))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
