"""Connected components by alternating large-star and small-star steps, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.skew import join_hot
from vellumine.session import cut, sweep


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, root) of every node that the edges (a, b) name; root is the least node reached.

    Each step is a partial minimum and an equi-join, in which a node with very many edges is
    joined apart, by broadcast; lineage is cut after each round. Rounds grow with the logarithm of the
    longest path (14 for a random path of 100,000 nodes) and go on until nothing changes; if
    ``most`` rounds don't do, it raises, so roots that aren't final are never returned.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both, least, "a", "n").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, "a", "n")
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        sweep(edges.sparkSession)
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
