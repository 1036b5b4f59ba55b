"""Connected components of a graph of 64-bit nodes, without the graph ever leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that can be reached.

    Alternates two steps until nothing changes: each node links its larger neighbours to the smallest node near
    it (large star), then its smaller ones (small star). The number of edges never grows, and rounds grow with
    the logarithm of a component's size. A node with very many neighbours costs no task more: smallest neighbours
    are aggregated before the shuffle, and the join that follows is one that Spark splits where it's skewed.
    """
    now = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("x"), "a", "b")
        small = small.select("x", F.explode(F.array("a", "b")).alias("y")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        now = kept(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
