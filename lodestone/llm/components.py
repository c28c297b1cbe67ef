"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, staged


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): of every node of edges (a, b), the smallest node that it reaches.

    Each step links every node's larger neighbours, then its smaller ones, to the smallest node around it,
    until nothing moves; steps grow with the logarithm of a component's size. Every step is one aggregate by
    node and one join back to the edges, in which the edges of hot nodes stay where they are; a step's edges are
    written to the shared folder, so lineage does not pile up. Loops and repeated edges do no harm, edges with a null end
    are left out; without edges there are no nodes.
    """
    sums = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    # a is the larger end of every edge, here and after each step
    now = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    held = now.select(*sums).first()
    for _ in range(most):
        # large star: u's larger neighbours go to the smallest of u and its neighbours
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = now.unionByName(up).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = hot_join(up, least, ["a"], total=held["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = staged(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        before, held = held, after.select(*sums).first()
        if before == held:
            break
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
