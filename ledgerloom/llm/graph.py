"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Components of undirected ``edges(a, b)`` of longs: one row ``(node, root)`` per node of an edge.

    ``root`` is the smallest node of the component. Each round links the larger neighbours of every node to its
    smallest neighbour, then the smaller ones (large star, small star); a few rounds suffice for any diameter, as
    the paths halve. Sums are map-side combined and the joins can be split where a node has many edges. Each round
    is a written table, so a lost executor costs one round. Loops, nulls and repeated edges are ignored.
    """
    edges = (edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges, seen = materialise(edges, name), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        stars = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            return (stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .union(stars.select("v", "v")).distinct())
        edges, seen = stars, state
