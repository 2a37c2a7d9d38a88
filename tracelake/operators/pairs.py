"""Tool calls and their results, and matching by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(calls: DataFrame, results: DataFrame, *, key: str = "session_id", tool: str = "tool_id", last: bool = True) -> DataFrame:
    """Calls with the last (or first) result of their id: ok and dur_ms, null without one; of a repeated
    call id the last call counts. Durations are never negative."""
    pick = F.max_by if last else F.min_by
    uses = calls.groupBy(key, tool).agg(F.max_by(F.struct(*[c for c in calls.columns if c not in (key, tool)]), "idx").alias("u"))
    got = results.groupBy(key, tool).agg(pick(F.struct("ok", "t_ms"), "idx").alias("r"))
    out = uses.join(got, [key, tool], "left")
    return out.select(key, tool, "u.*", F.col("r.ok").alias("ok"), F.when(F.col("r.t_ms").isNotNull(), F.greatest(F.lit(0), F.col("r.t_ms") - F.col("u.t_ms"))).alias("dur_ms"))


def by_place(left: DataFrame, right: DataFrame, keys: list[str], lcol: str, rcol: str) -> DataFrame:
    """The k-th of the left with the k-th of the right, ordered by their columns; the longer side pairs with null."""
    number = lambda df, c: df.select(*keys, F.col(c).alias(c), F.row_number().over(Window.partitionBy(*keys).orderBy(c)).cast("long").alias("pos"))
    return number(left, lcol).join(number(right, rcol), [*keys, "pos"], "full").select(*keys, "pos", lcol, rcol)
