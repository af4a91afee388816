"""Connected components of links that are too many for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import stored


def _linked(edges: DataFrame) -> DataFrame:
    """(u, v), u > v, without repeats and loops."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    hung = edges.join(least, edges["u"] == least["n"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _linked(hung.union(least.select("n", "m").toDF("u", "v")))


def components(nodes: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """(node, label): the smallest ``label`` in each node's component.

    ``nodes`` is (node, label), ``edges`` (a, b) in either direction; edges of unknown
    nodes link what they join. Alternating large and small stars turn each component
    into a star around its smallest node: the rounds grow with the square of the logarithm
    of its size at most, whatever its diameter. Each round is written to the shared
    folder, so a lost executor costs one round. Minima are combined before they are
    shuffled; the edges of a hub are split by Spark's skew join.
    """
    current = stored(_linked(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(current)
    while seen[0]:
        current = stored(_small_star(_large_star(current)), "edges")
        now = mark(current)
        if now == seen:
            break
        seen = now
    root = nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("_root")), "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    best = root.groupBy("_root").agg(F.min(label).alias("_best"))
    return root.join(best, "_root").select("node", F.col("_best").alias(label))
