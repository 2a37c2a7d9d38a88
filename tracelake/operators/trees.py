"""Parent-pointer trees: closure from the roots, with what is inherited downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(nodes: DataFrame, root: Column) -> DataFrame:
    """(id, parent, grp, label, depth) of all nodes reachable from the roots inside their group; the label
    is the root's. Levels are joined by Spark's recursive CTE."""
    spark = nodes.sparkSession
    flat = nodes.select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), F.col("grp").cast("long").alias("grp"), F.col("label").cast("string").alias("label"), root.alias("is_root"))
    return spark.sql(
        """WITH RECURSIVE tree(id, parent, grp, label, depth) AS (
             SELECT id, parent, grp, label, 0 FROM {nodes} WHERE is_root
             UNION ALL
             SELECT n.id, n.parent, n.grp, t.label, t.depth + 1 FROM tree t JOIN {nodes} n ON n.parent = t.id AND n.grp = t.grp AND NOT n.is_root)
           SELECT * FROM tree""",
        nodes=flat,
    )
