"""Connected components of an edge table, by alternating large and small stars, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import materialize

#: Rounds after which a graph that hasn't settled is an error; the number needed grows with the log of the longest path.
MAX_ROUNDS = 40


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, move to the smallest node in reach.

    Least neighbours are written before they are joined, so that both sides of the join are plain exchanges: a node with
    very many larger neighbours is pre-aggregated, and its join can be split. Smaller neighbours are few after that.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    least = materialize(least, "least")
    large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node in reach.

    edges: (a, b) long, in any direction; loops and nulls are ignored.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, edges = mark, materialize(_stars(edges), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
