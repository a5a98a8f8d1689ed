"""Connected components of a table of links, by alternating star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.sources.scratch import materialise



def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours to the smallest of them. Every edge has v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    `links` has two whole-number columns, `a` and `b`. Both star steps keep the components and
    shrink the distances; they end when the edges are stars around the smallest nodes. Edges are
    aggregated per task before each shuffle, and each round is stored, so that a lost executor
    costs one round at most.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialise(edges.distinct())
    before = None
    while True:
        edges = materialise(_small_star(_large_star(edges)).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )
