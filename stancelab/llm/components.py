"""Connected components of a link table, by alternating stars; nothing leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """``links`` (a, b) -> (node, root): root is the least node of the component.

    Large-star then small-star per round: every node points at the least neighbour it has seen,
    O(log n) rounds, each a grouping by node with a map-side ``min``.  A node with very many
    neighbours never gathers them: the minimum is an aggregate, joined back to the links.
    Self-links and repeated links are allowed; null ends are ignored.  Raises if ``max_rounds``
    did not suffice.
    """
    edges = scratch.table(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), "links")
    for _ in range(max_rounds):
        # large star: neighbours above a node move to the least of its neighbourhood
        both = edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")).union(
            edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("r"))
        large = (both.where("m > n").join(least, "n")
                 .select(F.col("r").alias("lo"), F.col("m").alias("hi")).where("lo <> hi"))
        # small star: neighbours below a node, and the node itself, move to the least of them
        down = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = (large.join(down, "hi").select(F.col("r").alias("lo"), F.col("lo").alias("hi"))
                 .union(down.select(F.col("r").alias("lo"), "hi")).where("lo <> hi").distinct())
        after = scratch.table(small, "stars")
        # a forest of stars: every node hangs on one root, and no root hangs on another
        again = after.groupBy("hi").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hi").union(
            after.select(F.col("lo").alias("hi")).join(after.select("hi"), "hi", "left_semi"))
        done = again.isEmpty()
        scratch.drop(edges)
        edges = after
        if done:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
