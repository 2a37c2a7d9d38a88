"""The rollout format: envelope records, forked files, cumulative counters, scripts with nested calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import records as R
from tracelake.operators.documents import patch_ops
from tracelake.sources.transcripts import FORK_MARKER, SNIPPET, block_text, ms, text

COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")


#: The type of an agent that was started without a task name.
NAMELESS_AGENT = "agent"


def files(records: DataFrame) -> DataFrame:
    """One row for each file: id, session_id, cwd, parent, agent_path, depth, from its first record."""
    first = records.groupBy("path").agg(F.min("line_no").alias("line_no"))
    head = records.join(first, ["path", "line_no"]).filter(text("rec", "$.type") == "session_meta")
    p = lambda k: text("rec", f"$.payload.{k}")
    spawn = "source.subagent.thread_spawn"
    return head.select("path", F.coalesce(p("id"), p("session_id")).alias("id"), F.coalesce(p("session_id"), p("id")).alias("session_id"), p("cwd").alias("cwd"), p("cli_version").alias("version"), p("thread_source").alias("thread_source"), p(f"{spawn}.parent_thread_id").alias("parent"), p(f"{spawn}.agent_path").alias("agent_path"), text("rec", f"$.payload.{spawn}.depth", "int").alias("depth"))


def tree(metas: DataFrame) -> DataFrame:
    """(root, id, depth, path) of every rollout reachable from a root by parent and equal session id; by
    a recursive CTE, in the order root, depth, path."""
    return metas.sparkSession.sql(
        """WITH RECURSIVE t(root, id, session_id, level, path) AS (
             SELECT id, id, session_id, 0, path FROM {m} WHERE parent IS NULL
             UNION ALL
             SELECT t.root, m.id, m.session_id, t.level + 1, m.path FROM t JOIN {m} m ON m.parent = t.id AND m.session_id = t.session_id)
           SELECT root, id, session_id, level, path FROM t ORDER BY root, level, path""",
        m=metas,
    )


def local(records: DataFrame, metas: DataFrame) -> DataFrame:
    """Records a file owns, with local_start: a child begins at its last activation message. idx is the
    physical line number."""
    rows = records.select("path", F.col("line_no").alias("idx"), "rec").join(metas.select("path", "parent"), "path")
    mark = (text("rec", "$.type") == "response_item") & (text("rec", "$.payload.type") == "message") & (text("rec", "$.payload.role") == "developer") & block_text(text("rec", "$.payload.content", "variant")).contains(FORK_MARKER)
    start = F.max(F.when(F.coalesce(mark, F.lit(False)) & F.col("parent").isNotNull(), F.col("idx"))).over(Window.partitionBy("path"))
    return rows.withColumn("local_start", F.coalesce(start, F.lit(0)))


def _own(rows: DataFrame) -> DataFrame:
    return rows.filter("idx >= local_start")


def model(rows: DataFrame) -> DataFrame:
    """(path, model): that of the last turn context."""
    found = _own(rows).filter(text("rec", "$.type") == "turn_context")
    return found.groupBy("path").agg(F.max_by(text("rec", "$.payload.model"), F.when(text("rec", "$.payload.model").isNotNull(), F.col("idx"))).alias("model"))


def prompts(rows: DataFrame) -> DataFrame:
    t = R.squeeze(text("rec", "$.payload.message"))
    return _own(rows).filter((text("rec", "$.type") == "event_msg") & (text("rec", "$.payload.type") == "user_message") & (t != "")).select("path", "idx", F.substring(t, 1, 400).alias("prompt"))


def markers(rows: DataFrame) -> DataFrame:
    return _own(rows).filter((text("rec", "$.type") == "event_msg") & text("rec", "$.payload.type").isin("context_compacted", "compaction")).select("path", "idx")


def counters(rows: DataFrame) -> DataFrame:
    """(path, idx, and the four totals): own cumulative tokens, less the last totals before the fork."""
    get = lambda k: text("rec", f"$.payload.info.total_token_usage.{k}", "long")
    points = rows.filter((text("rec", "$.type") == "event_msg") & (text("rec", "$.payload.type") == "token_count") & F.coalesce(*[get(k) for k in COUNTERS]).isNotNull()).select("path", "idx", "local_start", *[F.coalesce(get(k), F.lit(0)).alias(k) for k in COUNTERS])
    before = points.filter("idx < local_start").groupBy("path").agg(*[F.max_by(k, "idx").alias(f"_{k}") for k in COUNTERS])
    own = _own(points).join(before, "path", "left")
    return own.select("path", "idx", *[F.greatest(F.lit(0), F.col(k) - F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in COUNTERS])


def calls(rows: DataFrame) -> DataFrame:
    """(path, idx, call_id, name, raw, output, dur_ms, ok): calls with the last output of their id."""
    kind = text("rec", "$.payload.type")
    own = _own(rows).filter(text("rec", "$.type") == "response_item").withColumn("t_ms", ms(text("rec", "$.timestamp")))
    asked = own.filter(kind.isin("function_call", "custom_tool_call"))
    value = F.when(kind == "function_call", text("rec", "$.payload.arguments", "variant")).otherwise(text("rec", "$.payload.input", "variant"))
    raw = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    asked = asked.select("path", "idx", "t_ms", text("rec", "$.payload.call_id").alias("call_id"), text("rec", "$.payload.name").alias("name"), raw.alias("raw"))
    got = own.filter(kind.isin("function_call_output", "custom_tool_call_output")).select("path", "idx", "t_ms", text("rec", "$.payload.call_id").alias("call_id"), block_text(text("rec", "$.payload.output", "variant")).alias("output"))
    got = got.groupBy("path", "call_id").agg(F.max_by(F.struct("output", F.col("t_ms").alias("end_ms")), "idx").alias("o"))
    out = asked.join(got, ["path", "call_id"], "left")
    return out.select("path", "idx", "call_id", "name", "raw", F.col("o.output").alias("output"), F.greatest(F.lit(0), F.col("o.end_ms") - F.col("t_ms")).alias("dur_ms"), F.when(F.col("o.output").isNotNull(), ~R.tool_failed(F.col("o.output"))).alias("ok"))


def decoded(raw: Column) -> Column:
    """Arguments as a JSON object; anything else as {"input": text}."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, raw).otherwise(F.to_json(F.struct(raw.alias("input"))))


def shell_rows(made: DataFrame, metas: DataFrame) -> DataFrame:
    """(path, idx, command, workdir) of the shell calls inside scripts."""
    src = made.join(metas.select("path", "cwd"), "path")
    return src.select("path", "idx", F.inline(R.shell_calls(F.col("raw"), F.col("cwd"))))


def patch_rows(made: DataFrame) -> DataFrame:
    """(source, idx, patch_no, line_no, text): lines of the patches inside scripts, for ``documents.patch_ops``."""
    one = made.select(F.col("path").alias("source"), "idx", F.posexplode(R.patch_texts(F.col("raw"))).alias("patch_no", "patch"))
    return one.select("source", "idx", "patch_no", F.posexplode(F.split("patch", "\n")).alias("line_no", "text"))


def tools(made: DataFrame, metas: DataFrame) -> DataFrame:
    """(path, seq, idx, call_id, name, brief, skills, agent_type, agent_desc, wlines, kind, val, action, ok, dur_ms,
    snippet): one table of tool calls for both formats. An ``exec`` is a PowerShell row for each shell call and a
    Write or Edit row for each file of its patches, or else one row of its script; spawn_agent is called Agent. seq
    is the place by idx, name and place in the call."""
    raw = F.col("raw")
    src = made.join(metas.select("path", "cwd"), "path", "left").withColumn("snippet", F.substring(F.trim(F.coalesce("output", F.lit(""))), 1, SNIPPET))
    keep = ["path", "idx", "call_id", "ok", "dur_ms", "snippet"]
    null = lambda kind: F.lit(None).cast(kind)

    def row(df: DataFrame, name: Column, brief: Column, part: Column, **more: Column) -> DataFrame:
        kinds = {"skills": "array<string>", "agent_type": "string", "agent_desc": "string", "wlines": "long", "kind": "string", "val": "long", "action": "string"}
        return df.select(*keep, name.alias("name"), brief.alias("brief"), part.cast("int").alias("_part"), *[(more[k].cast(t) if k in more else null(t)).alias(k) for k, t in kinds.items()])

    scripts = src.filter("name = 'exec'").withColumn("_shells", R.shell_calls(raw, F.col("cwd"))).withColumn("_patches", R.patch_texts(raw))
    shells = scripts.select(*keep, F.posexplode("_shells").alias("_n", "_call"))
    shell = F.substring(R.squeeze(F.col("_call.command")), 1, 300)
    out = row(shells, F.lit("PowerShell"), shell, F.col("_n"), skills=R.skill_mentions(F.col("_call.command")))
    lines = scripts.select(F.col("path").alias("_source"), "idx", F.posexplode("_patches").alias("_patch", "_text")).select("_source", "idx", "_patch", F.posexplode(F.split("_text", "\n")).alias("line_no", "text"))
    ops = patch_ops(lines, ["_source", "idx", "_patch"]).select(F.col("_source").alias("path"), "idx", "_patch", "ord", "action", F.col("path").alias("_file"), "added", "kind", "val")
    files_ = scripts.select(*keep).join(ops, ["path", "idx"])
    out = out.unionByName(row(files_, F.when(F.col("action") == "Add", "Write").otherwise("Edit"), F.col("_file"), 1000 * (1 + F.col("_patch")) + F.col("ord"), wlines=F.col("added"), kind=F.col("kind"), val=F.col("val"), action=F.col("action")))
    whole = scripts.filter((F.size("_shells") <= 0) & (F.size("_patches") <= 0))
    out = out.unionByName(row(whole, F.lit("exec"), F.substring(R.squeeze(raw), 1, 300), F.lit(0)))
    rest = src.filter("name <> 'exec'").withColumn("_args", decoded(raw))
    get = lambda k: F.get_json_object("_args", f"$.{k}")
    agent = F.col("name") == "spawn_agent"
    said = F.coalesce(get("message"), F.lit(""))
    # a message that starts like this is encrypted (fixed value)
    said = F.when(said.startswith("gAAAA"), F.coalesce(get("task_name"), F.lit(""))).otherwise(F.substring(said, 1, 240))
    out = out.unionByName(row(rest, F.when(agent, "Agent").otherwise(F.col("name")), R.tool_brief(F.col("_args")), F.lit(0), agent_type=F.when(agent, F.coalesce(F.nullif(get("task_name"), F.lit("")), F.lit(NAMELESS_AGENT))), agent_desc=F.when(agent, said)))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("idx", "name", "_part")).cast("long") - 1
    return out.withColumn("seq", seq).drop("_part")
