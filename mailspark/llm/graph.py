"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailspark.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Every node moves to its smallest neighbour and on to that one's; the edges between the places reached are the
    next round's. At least every second node of a component moves in each round, so the rounds grow with the logarithm
    of the largest component; each ends in a written table. Null ends and loops are left out.
    """
    edges = stored(edges.where("a < b OR a > b").select("a", "b").distinct(), "edges")
    placed = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node")
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moved = stored(near.join(onward, "to").select("node", "root"), "moved")
        if placed is None:
            placed = moved
        else:
            later = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            placed = stored(placed.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "placed")
        of_a = moved.select(F.col("node").alias("a"), F.col("root").alias("x"))
        of_b = moved.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = stored(edges.join(of_a, "a").join(of_b, "b").where("x <> y").select(
            F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return placed if placed is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
