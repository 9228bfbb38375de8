"""Connected components of an edge table by least labels with pointer jumping, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges between longs -> (node, root): the least node of each node's component. Every round takes the
    least label among a node and its neighbours, then follows labels once; rounds grow with the logarithm of the
    longest path. Each round is written out, so lost executors cost one round at most."""
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hooked = written(hooked, "labels")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = hooked.join(jump.hint("merge"), "root").select("node", "old", F.least("root", "further").alias("root"))
        labels = written(moved, "labels")
        if labels.filter("old <> root").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
