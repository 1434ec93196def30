"""Connected components by repeated contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtrail.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the least node of the component of each node that has an edge.

    In each turn every node takes its least neighbour as parent, chains of parents are shortened twice, and the edges are drawn
    anew between the parents, until none is left; the number of nodes with edges at least halves each time. Every turn's
    state is written to the shared folder. Nothing but a count reaches the driver.
    """
    edges = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = durable(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("up")).select(F.col("a").alias("node"), "up"), "cc-parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        parent = durable(parent, "cc-parents")
        if labels is None:
            labels = parent.select("node", F.col("up").alias("label"))
        else:
            step = parent.select(F.col("node").alias("label"), "up")
            labels = durable(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(a, "a").join(b, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        edges = durable(edges, "cc-edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
