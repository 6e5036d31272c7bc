"""Connected components of an edge table, by smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklot.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Rounds of smallest neighbouring label and one pointer jump, each written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. A hub's neighbours meet in a minimum that is combined before
    the shuffle, never in a list.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("met"))
        jump = labels.select(F.col("node").alias("met"), F.col("component").alias("further"))
        new = materialize(met.join(jump, "met", "left").select("node", "old", F.least("met", "further").alias("component")), "labels")
        discard(labels)
        labels = new.select("node", "component")
        labels.scratch = new.scratch
        if new.where("old <> component").isEmpty():
            discard(both)
            return labels
