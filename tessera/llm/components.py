"""Connected components by contraction of the edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, staged


def components(edges: DataFrame, path: str) -> DataFrame:
    """node, component (the smallest node reachable) of each node of edges (a, b: long).

    A round points every node at its smallest neighbour or itself, follows the pointers to the roots by doubling, and
    puts the roots in the nodes' places in the edges. Roots are smaller than all their neighbours, so only one root for
    each other node is still one after the next round: two rounds halve a component's nodes at least. The rounds grow
    with the logarithm of the nodes, the doublings of a round with that of its longest path. Every step is a table under
    path that the next one reads, so no plan grows. Hot nodes are aggregated before the shuffle, and what is joined to a
    hot root has one row a node, so adaptive execution can split it.
    """
    spark, known, n = edges.sparkSession, None, 0
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), f"{path}/map-{n}-0")
        to, jumps = _roots(to, f"{path}/map-{n}")
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        pairs = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = staged(pairs.distinct(), f"{path}/edges-{n}")
        if known is None:
            known = to
        else:
            moved = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            known = staged(known.join(moved, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{path}/known-{n}")
            remove(spark, f"{path}/map-{n}-{jumps}")
        if n:
            remove(spark, f"{path}/edges-{n - 1}")
        n += 1
        if edges.isEmpty():
            return known.select("node", F.col("to").alias("component"))


def _roots(to: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The pointers (node, to) followed to their roots, and the number of doublings."""
    jumps = 0
    while True:
        moving = to.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("next"))
        if to.join(moving, "to", "left_semi").isEmpty():
            return to, jumps
        jumps += 1
        to = staged(to.join(moving, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{path}-{jumps}")
        remove(to.sparkSession, f"{path}-{jumps - 1}")
