"""Connected components by label propagation with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.store import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for ``edges`` (a, b): label is the smallest node reachable. Each round takes
    the least label among the neighbours, then the label's own label; hubs only meet in a
    minimum with map-side combine, and one number a round goes to the driver."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        least = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(least, labels["node"] == least["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = cut(step, "labels")
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = cut(step.join(up, F.col("label") == F.col("n2"), "left").select("node", "old", F.least("label", F.coalesce("l2", "label")).alias("label")), "labels")
        changed = new.filter("label < old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
