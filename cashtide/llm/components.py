"""Connected components over edges, by alternating large-star and small-star steps.

Each step is a grouping and a join on the edges, so nothing but edges is ever moved and no component is
gathered anywhere. Steps are written to the shared folder: a lost executor costs the step it was working on. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component``, the smallest node it is connected to, for the ends of all edges.

    ``edges`` has columns a and b of one ordered type. Edges with a null end join nothing; loops and repeated
    edges are fine. Nodes without an edge are not listed.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL")
    found = written(
        ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _settled(found):
        found = written(_small_star(_large_star(found)), "edges")
    loops = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return loops.join(found.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )


def _settled(edges: DataFrame) -> bool:
    """Every node points once, at a node that points nowhere."""
    if edges.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    roots = edges.select(F.col("b").alias("a")).distinct()
    return not edges.join(roots, "a", "left_semi").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour (or at the node)."""
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Only edges that lead up from a node move: for those, a is the smaller end.
    upward = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return upward.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
