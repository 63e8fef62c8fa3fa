"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import keep


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter("v > u").join(least, "u")
    return out.select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point down (a < b): each node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    out = edges.join(least, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return out.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of a link (a, b); longs.

    The number of rounds grows with the logarithm of the longest path. Every round is written
    to the shared folder, so a lost executor costs one round. Group minima are partial
    aggregates, and the joins on a hub are plain shuffle joins that Spark can split."""
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    size = None
    while True:
        edges = keep(_small(_large(edges)), "stars")
        # A star forest is reached when no centre is also a leaf.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == size:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        size = now
