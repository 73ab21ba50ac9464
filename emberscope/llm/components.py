"""Connected components of a graph given by its edges, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import merge, removed, rewritten


def stars(graph: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) and its path: every node hooks to its least neighbour if that is less; its label is the end of its way of hooks.

    Ways fall, so they end; each round doubles the steps that a label is away, until none changes.
    """
    spark = graph.sparkSession
    labels, path = rewritten(graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    changed = True
    while changed:
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step, new = rewritten(labels.join(merge(jump), labels.label == F.col("_n")).select("node", F.col("label").alias("old"), F.col("_l").alias("label")))
        changed = not step.filter("label < old").isEmpty()
        removed(spark, path)
        labels, path = step.select("node", "label"), new
    return labels, path


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of ``edges`` (a, b) the smallest node that it reaches.

    Each round makes stars (the least neighbour is summed up before it is shuffled, so a hub's edges
    don't meet) and contracts each to its root.  A root that neither hooks nor is hooked to has
    neighbours that all went to lesser roots, so it hooks in the next round: two rounds at
    least halve the roots with edges, in any order of ids.  Rounds end when no edge is left; then the
    rounds' labels are chained, last ones first.  Every table is written to the shared folder.
    """
    spark = edges.sparkSession
    graph, path = rewritten(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds = []
    while not rounds or not graph.isEmpty():
        labels, at = stars(graph)
        rounds.append((labels, at))
        ends = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        left = graph.join(merge(ends), graph.a == F.col("_n")).select(F.col("_l").alias("a"), "b").distinct()
        left = left.join(merge(ends), left.b == F.col("_n")).select("a", F.col("_l").alias("b")).filter("a <> b").distinct()
        graph, new = rewritten(left)
        removed(spark, path)
        path = new
    removed(spark, path)
    labels, at = rounds.pop()
    while rounds:
        lower, below = rounds.pop()
        ends = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        labels, new = rewritten(lower.join(merge(ends), lower.label == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")))
        removed(spark, at)
        removed(spark, below)
        at = new
    return labels
