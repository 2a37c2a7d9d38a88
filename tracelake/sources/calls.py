"""One table of tool calls for both transcript formats, which rollups and lineage read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import pairs
from tracelake.sources import transcripts

#: Columns of the table, besides the key of the session.
COLUMNS = "format string, seq long, idx long, call_id string, name string, brief string, skills array<string>, agent_type string, wlines long, kind string, val long, ok boolean, dur_ms long, snippet string"
LAUNCHES = ("Agent", "Task")


def of_sessions(msgs: DataFrame, key: str = "path") -> DataFrame:
    """(key, COLUMNS) of session files: each call with its last result."""
    uses, results = transcripts.tool_uses(msgs, key), transcripts.tool_results(msgs, key)
    said = results.groupBy(key, "tool_id").agg(F.max_by("snippet", "idx").alias("snippet"))
    rows = pairs.pair(uses, results, key=key).join(said, [key, "tool_id"], "left")
    seq = F.row_number().over(Window.partitionBy(key).orderBy("idx", "pos")).cast("long") - 1
    skills = F.when(F.col("skill").isNotNull(), F.array("skill"))
    kind = F.when(F.col("name").isin(*LAUNCHES), F.coalesce(F.col("agent_type"), F.lit("agent")))
    return _shaped(rows.withColumnRenamed("tool_id", "call_id"), key, format=F.lit("session"), seq=seq, skills=skills, agent_type=kind)


def of_rollouts(tools: DataFrame, metas: DataFrame, key: str = "session_id") -> DataFrame:
    """The same of ``rollouts.tools``; the key is the rollout's id."""
    rows = tools.join(metas.select("path", F.col("id").alias(key)), "path")
    return _shaped(rows, key, format=F.lit("rollout"))


def _shaped(rows: DataFrame, key: str, **made) -> DataFrame:
    kinds = dict(c.split() for c in COLUMNS.split(", "))
    return rows.select(F.col(key).cast("string").alias(key), *[made.get(c, F.col(c)).cast(t).alias(c) for c, t in kinds.items()])


def table(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
