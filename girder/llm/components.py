"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation (with map-side combining) and one join on the node, and leaves a
graph with the same components; at the end each node points to the smallest of its component. A
node with very many edges is a skewed key of a plain equality join, which adaptive execution
splits. The edges of each round are written to the checkpoint folder. The rounds end when the graph is
a set of stars, which is found out exactly; the driver sees whether it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: root is the smallest node reachable.

    Nodes are integers. Edges may repeat and may come in either direction or both; self-loops and
    rows with a null are left out. An empty table gives no rows.
    """
    edges = saved(edges.select("a", "b").where("a <> b").distinct())
    while True:
        edges = saved(_small(_large(edges)))
        # Stars, each with its smallest node in the middle: no middle has an edge to a smaller one, and
        # no node has two.
        below = edges.select(F.col("b").alias("a")).distinct()
        if edges.join(below, "a", "left_semi").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
