"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeqa.scale import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b); the label is one node of its component.

    Each turn every node points to its smallest neighbour, or itself if that is smaller, and edges
    are drawn anew between what their ends point to; that at least halves the nodes with edges, so
    the turns grow with the logarithm of a component's size. Neighbours are reduced by a minimum,
    summed in each task first: a node with any number of edges is one row a task. Loops and
    repeated edges are allowed.
    """
    left = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).where("1 = 0")
    first = True
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b"))
        points = cut_lineage(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        if first:
            labels, first = points.select("node", F.col("to").alias("label")), False
        else:
            onward = points.select(F.col("node").alias("label"), "to")
            labels = cut_lineage(
                labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            )
        at = lambda c: points.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        moved = left.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        left = cut_lineage(
            moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
    return labels
