"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut_lineage


#: Rows (a few dozen bytes each) up to which a written table of keys goes to all tasks.
BROADCAST_KEYS = 500_000


def counted(keys: DataFrame) -> DataFrame:
    """Narrow keys, written and counted: to be broadcast if few, else joined by a shuffle."""
    keys = cut_lineage(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node with an edge.

    ``edges`` has the long columns a and b. In a round each node takes the smallest of
    itself and its neighbours, and edges move to the nodes taken; every node that is
    not the smallest of its neighbourhood vanishes from them, so the edges shrink until
    none is left. Only minima are shuffled (combined before), never neighbour lists;
    each round is written to the shared folder.
    """
    edges = cut_lineage(edges.filter("a <> b").distinct())
    steps: list[DataFrame] = []
    while True:
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut_lineage(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        steps.append(step)
        left = step.select("a", F.col("to").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = cut_lineage(
            edges.join(left, "a").join(right, "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            break
    roots = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        moved = step.select(F.col("a").alias("root"), "to")
        roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return roots
