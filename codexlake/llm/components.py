"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and an equi-join;
no neighbour list is ever gathered, so a hub costs no more than its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROUNDS = 40


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star: every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return large.where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Small-star: every node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges are a star forest: every larger end occurs once, and no end is both a centre and a leaf."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("leaf")).union(edges.select("a", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return nodes.where("leaves > 1 or leaves = 1 and least = 0").agg(F.count("*")).collect()[0][0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the least node reachable.

    Null ends and self-loops are ignored. Raises if the rounds do not suffice
    (they are logarithmic in the longest chain).
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = checkpointed(e.where(f"`{a}` is not null and `{b}` is not null").where("a < b").distinct())
    for _ in range(ROUNDS):
        if _settled(e):
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        e = checkpointed(_small(_stars(e)))
    raise RuntimeError("components did not settle")
