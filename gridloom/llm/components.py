"""Connected components of links as DataFrame joins: labels of neighbours and label jumps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); component is the least node that can be reached.

    Alternating star contraction: each node links its larger neighbours to its least one (large star), then its
    smaller neighbours to that (small star). Links only ever point to smaller nodes, the number of rounds is
    logarithmic in practice, and each round is written to the shared folder. A node with very many links is
    aggregated map-side for its least neighbour and never gathered in one task. Null nodes take no part.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = settle(edges, "links")
    while True:
        after = settle(_small_star(_large_star(edges)), "links")
        same = edges.join(after, ["a", "b"], "left_anti").isEmpty() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # a node with very many links meets a single row here, so a partition that it makes large can be split
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
