"""Connected components of a link table, as joins that meet in a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, skew_join, written


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until every node points straight at its root.
    Each step groups by a node with a partial minimum and joins that back; no group is gathered, and each step is
    written so that lineage stays short. Ids may be of any type that has an order; loops and repeats don't matter.
    """
    edges = written(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), tag)
    while not edges.isEmpty():
        # large star: every neighbour of u that is larger than u is linked to the least of u and its neighbours
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), tag)
        large = skew_join(both, least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), tag)
        discard(edges, least)
        # small star: u and its smaller neighbours are linked to the least of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        small = skew_join(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.where(F.col("a") != F.col("b")).distinct(), tag)
        discard(large, least)
        # done when no node has two parents, and none is a parent and a child
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("child")))
        seen = ends.groupBy("n").agg(F.sum("child").alias("parents"), F.min("child").alias("lo"))
        if seen.where("parents > 1 OR (parents = 1 AND lo = 0)").isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
