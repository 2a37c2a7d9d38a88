"""Read and write lineage: accumulation, edges, coverage against an inventory, stage views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import intervals


def joined(c: str | Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def accumulate(reads: DataFrame, keys: list[str], source: str | None = None, total: str | None = None) -> DataFrame:
    """Per keys (with the path): reads, cumulative lines with repeats, lines once, last line touched, and the
    names in the column ``source`` and the largest length of the file in the column ``total``, if they are named."""
    ok = reads.filter("n > 0")
    more = ([joined(source).alias("sources")] if source else []) + ([F.max(total).alias("max_total")] if total else [])
    cum = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("lines_cum"), F.max(F.col("start_line") + F.col("n") - 1).alias("last_line"), *more)
    once = intervals.line_spans(ok, keys).groupBy(*keys).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines_dedup"))
    return cum.join(once, keys)


def chain(reads: DataFrame, writes: DataFrame, handed: DataFrame, *, scope: str = "lineage", agent: str = "session_id") -> DataFrame:
    """(scope, source, document, output, first_agents, second_agents): an agent reads a source and writes a document, which
    another agent reads (``handed``) that writes the output. Both halves are counted before they meet at the document."""
    side = lambda df, name: df.select(scope, agent, F.col("path").alias(name)).distinct()
    w = side(writes, "document")
    half = lambda left, right, by, n: left.join(right, [scope, agent]).groupBy(scope, *by).agg(F.count(F.lit(1)).alias(n))
    first = half(side(reads, "source"), w, ["source", "document"], "first_agents")
    second = half(side(handed, "document"), w.withColumnRenamed("document", "output"), ["document", "output"], "second_agents")
    return first.join(second.filter("document <> output"), [scope, "document"])


def main_agents(rows: DataFrame, is_main: Column, agent: Column, stage: str = "stage") -> DataFrame:
    """``rows`` with ``agent_id``: what the main thread does belongs to one agent for each of its stages."""
    return rows.withColumn("agent_id", F.when(is_main, F.concat(F.lit("__main__:"), F.coalesce(stage, F.lit("?")))).otherwise(agent))


def agent_rows(reads: DataFrame, writes: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """A row for each agent (keys) that reads or writes: its role by the best of what it wrote (``kind`` of a write: ets, spec or
    plan), files and lines read, each line once, files written by kind and in all, and lines added."""
    own = accumulate(reads, [*keys, "path"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_read"), F.sum("lines_cum").alias("lines_cum"), F.sum("lines_dedup").alias("lines_dedup"))
    of = lambda k: F.count_distinct(F.when(F.col("_kind") == k, F.col("path")))
    added = F.greatest(F.col("val"), F.lit(0))
    made = writes.withColumn("_kind", kind).groupBy(*keys).agg(
        F.count_distinct("path").alias("n_out"), of("ets").alias("n_ets"), of("spec").alias("n_spec"), of("plan").alias("n_plan"), F.sum(added).alias("lines_added"), F.coalesce(F.sum(F.when(F.col("_kind") == "ets", added)), F.lit(0)).alias("lines_ets")
    )
    out = own.join(made, keys, "full").fillna(0, ["n_read", "lines_cum", "lines_dedup", "n_out", "n_ets", "n_spec", "n_plan", "lines_added", "lines_ets"])
    role = F.when(F.col("n_ets") > 0, "execute").when(F.col("n_spec") > 0, "spec").when(F.col("n_plan") > 0, "plan").otherwise("other")
    return out.withColumn("role", role)


def agent_spans(reads: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, path, start_line, end_line, via): the merged lines that each agent saw of a file, and by what."""
    via = reads.filter("n > 0").groupBy(*keys, "path").agg(joined(source).alias("via"))
    return intervals.line_spans(reads, [*keys, "path"]).join(via, [*keys, "path"])


def edges(reads: DataFrame, writes: DataFrame, dropped: DataFrame, scope: str = "lineage", agent: str = "session_id", *, probed: DataFrame | None = None, external: Column | None = None) -> DataFrame:
    """(scope, path, readers, writers, with ``probed`` also probed_by): agents by path, without the ``dropped`` ones and without
    paths that are ``external`` (an expression over path)."""
    side = lambda df, kind: df.join(dropped.select(agent), agent, "left_anti").select(scope, "path", agent, F.lit(kind).alias("kind")).distinct()
    both = side(reads, "r").unionByName(side(writes, "w"))
    if probed is not None:
        both = both.unionByName(side(probed, "p"))
    if external is not None:
        both = both.filter(~external)
    names = lambda k: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col(agent)))), lambda x: x.cast("string")), ",")
    return both.groupBy(scope, "path").agg(names("r").alias("readers"), names("w").alias("writers"), *([names("p").alias("probed_by")] if probed is not None else []))


def unread(inventory: DataFrame, reads: DataFrame, scope: str = "lineage") -> DataFrame:
    """Inventory files that a scope never read, paths compared without case."""
    scopes = reads.select(scope).distinct()
    wanted = scopes.crossJoin(inventory.select("path"))  # one row for each scope and file is what the result is made of
    seen = reads.select(F.col(scope).alias("_s"), F.lower("path").alias("_p")).distinct()
    return wanted.join(seen, (F.col(scope) == F.col("_s")) & (F.lower("path") == F.col("_p")), "left_anti")


def out_of_scope(reads: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Read files that the inventory doesn't have."""
    inv = inventory.select(F.lower("path").alias("_p")).distinct()
    return reads.select(*keys, "path").distinct().join(inv, F.lower("path") == F.col("_p"), "left_anti")


def coverage(reads: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Files and lines read inside the inventory, each line once, with the inventory's totals."""
    total = inventory.agg(F.count(F.lit(1)).alias("total_files"), F.sum("n_lines").alias("total_lines"))
    spans = intervals.clip(intervals.line_spans(reads, [*keys, "path"]), inventory, keys)
    per = spans.groupBy(*keys).agg(F.count_distinct(F.lower("path")).alias("files"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    out = reads.select(*keys).distinct().join(per, keys, "left").fillna(0, ["files", "lines"])
    return out.crossJoin(F.broadcast(total))


def stage_view(reads: DataFrame, inventory: DataFrame, keys: list[str], agent: str = "session_id") -> DataFrame:
    """Per keys (a scope and stage): files and agents, cumulative lines, and in-scope lines once across agents,
    in all and in code files."""
    ok = reads.filter("n > 0")
    cum = ok.groupBy(*keys).agg(F.count_distinct("path").alias("files"), F.count_distinct(agent).alias("agents"), F.sum("n").alias("lines_cum"))
    spans = intervals.clip(intervals.line_spans(ok, [*keys, "path"]), inventory, keys)
    n = F.col("end_line") - F.col("start_line") + 1
    once = spans.groupBy(*keys).agg(F.sum(n).alias("lines_dedup"), F.coalesce(F.sum(F.when(F.col("is_code"), n)), F.lit(0)).alias("code_lines"))
    touched = spans.select(*keys, "path", "n_lines").distinct().groupBy(*keys).agg(F.sum("n_lines").alias("lines_touched"))
    return cum.join(once, keys, "left").join(touched, keys, "left").fillna(0, ["lines_dedup", "code_lines", "lines_touched"])


def handoff(segs: DataFrame, writes: DataFrame, *, key: str = "session_id", spec: str = "plan", by_agent: Column | None = None) -> DataFrame:
    """(key, cut): the first segment of the spec stage, else the first in which a sub-agent wrote; ``by_agent`` tells which
    writes are a sub-agent's, without it all are."""
    first_spec = segs.filter(F.col("stage") == spec).groupBy(key).agg(F.min("seg_no").alias("_a"))
    first_write = (writes if by_agent is None else writes.filter(by_agent)).groupBy(key).agg(F.min("seg_no").alias("_b"))
    return segs.select(key).distinct().join(first_spec, key, "left").join(first_write, key, "left").select(key, F.coalesce("_a", "_b").alias("cut")).filter("cut is not null")


def lost(reads: DataFrame, cuts: DataFrame, *, key: str = "session_id") -> DataFrame:
    """(key, cut, path): files read up to the cut and never after it."""
    rows = reads.join(cuts, key).select(key, "cut", "path", (F.col("seg_no") <= F.col("cut")).alias("up")).distinct()
    return rows.groupBy(key, "cut", "path").agg(F.bool_and("up").alias("only_up")).filter("only_up").drop("only_up")


def owned_lines(replayed: DataFrame, keys: list[str], path: str, order: list[str]) -> DataFrame:
    """Final lines of each file given to the stage that wrote last; ``replayed`` has lines and stage."""
    last = replayed.groupBy(*keys, path).agg(F.max_by(F.struct("stage", "lines"), F.struct(*order)).alias("l"))
    return last.groupBy(*keys, F.col("l.stage").alias("stage")).agg(F.sum("l.lines").alias("final_lines"), F.count(F.lit(1)).alias("files_owned"))


def thin(df: DataFrame, keys: list[str], order: str, points: int) -> DataFrame:
    """Every k-th row of each key and the last, about ``points`` of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return rows.filter((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")
