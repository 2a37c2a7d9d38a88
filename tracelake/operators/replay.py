"""Final state of written files from set and delta events, and its timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every event with ``lines`` after it: set puts the value, delta adds and never goes below zero.
    Closed form: inside a run after a set, the running sum less its least value below zero. ``order``
    must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_seg", F.sum(F.when(F.col("kind") == "set", 1).otherwise(0)).over(upto))
    run = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("val").over(run))
    # a set's own value is taken as it is, so the floor starts behind it
    floor = F.least(F.lit(0), F.min(F.when(F.col("kind") == "delta", F.col("_sum"))).over(run))
    return rows.withColumn("lines", F.col("_sum") - F.coalesce(floor, F.lit(0))).drop("_seg", "_sum")


def final_lines(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    done = replay(events, keys, order)
    return done.groupBy(*keys).agg(F.max_by("lines", F.struct(*order)).alias("final_lines"), F.count(F.lit(1)).alias("n_events"))


def timeline(events: DataFrame, scope: list[str], path: str, order: list[str], points: int = 1500) -> DataFrame:
    """Total lines of all files of a scope after each event, thinned to every k-th and the last."""
    done = replay(events, [*scope, path], order)
    before = F.coalesce(F.lag("lines").over(Window.partitionBy(*scope, path).orderBy(*order)), F.lit(0))
    w = Window.partitionBy(*scope).orderBy(*order)
    rows = done.withColumn("_d", F.col("lines") - before).withColumn("total", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("pos", F.row_number().over(w).cast("long") - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*scope)))
    k = F.when(F.col("_n") > points, F.floor(F.col("_n") / points) + 1).otherwise(F.lit(1))
    return rows.filter((F.col("pos") % k == 0) | (F.col("pos") == F.col("_n") - 1)).select(*scope, "pos", "t_ms", "total")
