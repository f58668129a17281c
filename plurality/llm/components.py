"""Connected components of an edge table, by pointing to smaller nodes and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, hot_join

#: Times that pointers are doubled in a round.
DOUBLINGS = 2


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges(a long, b long)``.

    In a round each node points to its smallest neighbour if that is smaller than itself
    (aggregated before the shuffle, so a node with very many edges is no hot spot),
    pointers are followed to pointers, and edges are moved to where their ends point.
    Edges inside one target vanish, so the edge table shrinks from round to round; rounds
    end when it is empty. Every table is written to the shared folder; only how many edges
    are left reaches the driver. Ends of very many edges are sent to all executors for the
    joins (see ``hot_join``), not met in one task. Rows with a null end are ignored; nodes
    without edges do not appear.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = scratch.keep(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while (size := left.count()) or not rounds:
        both = left.select("a", "b").union(left.select("b", "a"))
        # as many edges as a node has, as many nodes can point to it
        points = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"), F.count("*").alias("degree")))
        for _ in range(DOUBLINGS):
            hop = points.select(F.col("node").alias("label"), F.col("label").alias("far"), F.col("degree").alias("_d"))
            further = scratch.keep(hot_join(points, hop, "label", F.col("_d"), 2 * size).select("node", F.col("far").alias("label"), "degree"))
            scratch.drop(points)
            points = further
        rounds.append(points)
        moved = left
        for end in ("a", "b"):
            target = points.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}"), F.col("degree").alias(f"_{end}"))
            moved = hot_join(moved, target, end, F.col(f"_{end}"), 2 * size)
        targets = moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        fewer = scratch.keep(targets)
        scratch.drop(left)
        left = fewer
    found = rounds.pop().select("node", F.col("label").alias("component"))
    while rounds:
        later = found.select(F.col("node").alias("label"), "component")
        found = rounds.pop().join(later, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    return found
