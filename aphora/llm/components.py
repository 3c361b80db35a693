"""Connected components of an edge list, as alternating Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Tables of their own, so that the joins may split a node with very many neighbours.
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Every edge has u > v here."""
    low = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    near = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges between numbers -> (node, root): the smallest node of each node's component, roots left out.

    Large-star and small-star steps alternate until the edges are the stars of the components; a step keeps the
    components as they are and never makes more edges than there were. Each state is a table in the shared folder.
    Repeated edges and loops do no harm; an empty list gives an empty result.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = stored(_large_star(now).where("u <> v").distinct(), "edges")
        now = stored(_small_star(large).where("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every larger end has one edge, and is no smaller end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 or ups = 1 and least = 0").isEmpty()
