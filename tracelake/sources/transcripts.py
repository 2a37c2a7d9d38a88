"""Reading append-only JSONL transcripts of many sessions into typed tables.

Bronze is one row for each line with its exact place in the file and the record as
VARIANT (a field may be a string in one record and an array in the next). Two formats
share the silver tables: ``session`` files (one message or event a line) and ``rollout``
files (an envelope with type and payload; files of sub-agents point at their parent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources import files

#: The message that marks where a forked rollout begins its own work (fixed value).
FORK_MARKER = "You are an agent in a team of agents"
SNIPPET = 220


def scan(spark: SparkSession, root: str, *, raw: bool = False) -> DataFrame:
    """(path, line_no, idx, rec, with ``raw`` also value): parsable lines of all files below ``root`` in file order. line_no is the
    physical line, idx counts parsable records; both from 0. Blank and broken lines only take a line_no.
    Small files are read whole, many to a task, and numbered where they are read, without a shuffle; of the others lines are numbered
    inside the blocks in which Spark reads a file, and a block begins at the sums of those before it: a huge file is as many tasks as it has blocks."""
    return _scan(spark, root, files.found(spark, root), raw)


def _scan(spark: SparkSession, root: str, listed: DataFrame | None, raw: bool = False) -> DataFrame:
    if listed is None:
        return _of_blocks(spark.read.option("recursiveFileLookup", "true").text(root), raw)
    whole, large = files.split(spark, listed)
    rows = _of_whole(whole, raw)
    return rows.unionByName(_of_blocks(spark.read.text(large), raw)) if large else rows


def _of_whole(whole: DataFrame, raw: bool) -> DataFrame:
    parsed = F.transform("lines", lambda x, i: F.struct(i.cast("long").alias("line_no"), F.trim(x).alias("value"), F.try_parse_json(F.trim(x)).alias("rec")))
    # what begins with a brace and parses is an object; the others need the schema
    ok = lambda x: F.when(x["value"].startswith("{"), x["rec"].isNotNull()).otherwise(F.coalesce(F.schema_of_variant(x["rec"]).startswith("OBJECT"), F.lit(False)))
    rows = whole.select("path", F.posexplode(F.filter(parsed, ok)).alias("idx", "_r"))
    return rows.select("path", "_r.line_no", F.col("idx").cast("long").alias("idx"), "_r.rec", *(["_r.value"] if raw else []))


def _of_blocks(lines: DataFrame, raw: bool) -> DataFrame:
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid"), F.trim("value").alias("value"))
    rows = rows.withColumn("rec", F.try_parse_json("value")).select("path", "_block", "_mid", "rec", *(["value"] if raw else [])).repartition("path", "_block")
    ok = F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    # the same columns as below, so that Spark reads and parses once for both
    sums = rows.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.count_if(ok).alias("_k"), F.max("_mid").alias("_mid"), *([F.max("value").alias("value")] if raw else []))
    before = Window.partitionBy("path").orderBy("_block")
    sums = sums.select(F.col("path").alias("_p"), F.col("_block").alias("_b"), (F.sum("_n").over(before) - F.col("_n")).alias("_n0"), (F.sum("_k").over(before) - F.col("_k")).alias("_k0"))
    w = Window.partitionBy("path", "_block").orderBy("_mid")
    own = rows.withColumn("_ok", ok).withColumn("_line", F.row_number().over(w).cast("long") - 1).withColumn("_i", F.count_if("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).filter("_ok")
    out = own.join(sums, (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return out.select("path", (F.col("_line") + F.col("_n0")).alias("line_no"), (F.col("_i") + F.col("_k0")).alias("idx"), "rec", *(["value"] if raw else []))


def text(col: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(col), path, kind)


def detect(records: DataFrame) -> DataFrame:
    """(path, format): by the first record of each file; null if neither format fits."""
    first = records.groupBy("path").agg(F.min_by("line_no", "line_no").alias("line_no"))
    return records.join(first, ["path", "line_no"]).select("path", _format().alias("format"))


def _format() -> Column:
    """The format of a file whose first record is rec."""
    meta = text("rec", "$.type") == "session_meta"
    has = F.coalesce(text("rec", "$.sessionId", "variant"), text("rec", "$.message", "variant"), text("rec", "$.uuid", "variant"), text("rec", "$.type", "variant")).isNotNull()
    rollout = meta & F.schema_of_variant(text("rec", "$.payload", "variant")).startswith("OBJECT")
    return F.when(F.coalesce(rollout, F.lit(False)), "rollout").when(~F.coalesce(meta, F.lit(False)) & has, "session")


def _listed(spark: SparkSession, root: str, own: DataFrame | None) -> DataFrame:
    """(path, size, mtime) of the files below ``root``, from what ``files.found`` gave, as Spark's binaryFile gives them."""
    if own is None:
        return spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return own.select(F.col("name").alias("path"), "size", F.timestamp_millis(F.floor(F.col("mtime") * 1000 + 1e-3)).alias("mtime"))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Sessions below ``root``, newest first: path, project, format, session_id, size, mtime. Files of
    sub-agents are left out."""
    found = files.found(spark, root)
    head = _scan(spark, root, found).filter("idx = 0")
    own = head.select("path", _format().alias("format"), F.coalesce(text("rec", "$.payload.id"), text("rec", "$.payload.session_id")).alias("_id"), text("rec", "$.payload.cwd").alias("_cwd"), text("rec", "$.payload.thread_source").alias("_src"))
    out = _listed(spark, root, found).join(own, "path").filter("format is not null and coalesce(_src, '') <> 'subagent'").filter(~F.col("path").contains("/subagents/"))
    name = F.element_at(F.split("path", "/"), -1)
    project = F.when(F.col("format") == "rollout", F.element_at(F.split("_cwd", r"[/\\]"), -1)).otherwise(F.element_at(F.split("path", "/"), -2))
    sid = F.when(F.col("format") == "rollout", F.col("_id")).otherwise(F.substring_index(name, ".", 1))
    return out.select("path", project.alias("project"), "format", sid.alias("session_id"), "size", "mtime").orderBy(F.desc("mtime"), "path")


def short_project(project: Column) -> Column:
    tail = F.regexp_extract(project, r"^.*-projects-(.*)$", 1)
    return F.when(tail != "", tail).otherwise(F.right(project, F.lit(30)))


def block_text(blocks: Column) -> Column:
    """Text of a content value: a string, or the texts of its blocks joined by line feeds."""
    parts = F.filter(F.transform(F.try_variant_get(blocks, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.schema_of_variant(blocks) == "STRING", F.try_variant_get(blocks, "$", "string")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit("")))


def _stamp(col: Column) -> Column:
    return F.try_to_timestamp(col)


def ms(col: Column) -> Column:
    return F.unix_millis(_stamp(col))


def messages(records: DataFrame, key: str = "path") -> DataFrame:
    """Session format: one row a record with its common fields."""
    r = "rec"
    return records.select(key, "idx", text(r, "$.timestamp").alias("ts"), ms(text(r, "$.timestamp")).alias("t_ms"), text(r, "$.type").alias("type"), text(r, "$.subtype").alias("subtype"), text(r, "$.promptSource").alias("source"), text(r, "$.attributionSkill").alias("attribution"), text(r, "$.message", "variant").alias("msg"), text(r, "$.toolUseResult", "variant").alias("result"))


def prompts(msgs: DataFrame, key: str = "path") -> DataFrame:
    body = F.try_variant_get("msg", "$.content", "variant")
    own = F.when(F.schema_of_variant(body) == "STRING", F.try_variant_get(body, "$", "string"))
    tidy = F.trim(F.regexp_replace(own, r"\s+", " "))
    return msgs.filter((F.col("type") == "user") & (F.col("source") == "typed")).select(key, "idx", "t_ms", F.substring(tidy, 1, 400).alias("prompt")).filter("prompt <> ''")


def _blocks(msgs: DataFrame, key: str) -> DataFrame:
    arr = F.try_variant_get("msg", "$.content", "array<variant>")
    rows = msgs.select(key, "idx", "t_ms", "result", F.posexplode(arr).alias("pos", "block"))
    return rows.withColumn("kind", text("block", "$.type"))


def tool_uses(msgs: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, pos, t_ms, tool_id, name, brief, skill, agent_type, wlines, kind, val): every tool call in order."""
    from tracelake.functions.records import base_skill, line_count, tool_brief

    b = _blocks(msgs, key).filter("kind = 'tool_use'").withColumn("input", F.to_json(text("block", "$.input", "variant")))
    name = text("block", "$.name")
    get = lambda k: F.get_json_object("input", f"$.{k}")
    edits = F.from_json(get("edits"), "array<struct<old_string: string, new_string: string>>")
    one = lambda t: line_count(F.coalesce(t, F.lit("")))
    many = lambda f: F.aggregate(edits, F.lit(0).cast("long"), lambda a, e: a + f(e))
    wrote = F.when(name == "Write", one(get("content"))).when(name == "Edit", one(get("new_string"))).when(name == "MultiEdit", many(lambda e: one(e["new_string"])))
    val = F.when(name == "Write", wrote).when(name == "Edit", wrote - one(get("old_string"))).when(name == "MultiEdit", many(lambda e: one(e["new_string"]) - one(e["old_string"])))
    kind = F.when(name == "Write", "set").when(name.isin("Edit", "MultiEdit"), "delta")
    return b.select(key, "idx", "pos", "t_ms", text("block", "$.id").alias("tool_id"), name.alias("name"), tool_brief(F.col("input")).alias("brief"), F.when(name == "Skill", base_skill(get("skill"))).alias("skill"), F.when(name.isin("Agent", "Task"), get("subagent_type")).alias("agent_type"), wrote.alias("wlines"), kind.alias("kind"), val.alias("val"))


def tool_results(msgs: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, t_ms, tool_id, ok, output, snippet, read_start, read_n, read_total)."""
    b = _blocks(msgs, key).filter("kind = 'tool_result'")
    own = block_text(text("block", "$.content", "variant"))
    streams = F.concat_ws("\n", F.nullif(text("result", "$.stdout"), F.lit("")), F.nullif(text("result", "$.stderr"), F.lit("")))
    rest = block_text(text("result", "$.content", "variant"))
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"\S")
    output = F.when(~blank(own), own).when(~blank(streams), streams).otherwise(F.coalesce(rest, F.lit("")))
    # a snippet is of the first that is not blank
    one = [own, text("result", "$.stdout"), text("result", "$.stderr"), rest]
    snippet = F.substring(F.regexp_replace(F.coalesce(*[F.when(~blank(c), c) for c in one], F.lit("")), r"^\s+|\s+$", ""), 1, SNIPPET)
    n = text("result", "$.file.numLines", "long")
    return b.select(key, "idx", "t_ms", text("block", "$.tool_use_id").alias("tool_id"), (~F.coalesce(text("block", "$.is_error", "boolean"), F.lit(False))).alias("ok"), output.alias("output"), snippet.alias("snippet"), F.when(n.isNotNull(), F.coalesce(text("result", "$.file.startLine", "long"), F.lit(1))).alias("read_start"), n.alias("read_n"), text("result", "$.file.totalLines", "long").alias("read_total"))


def usage(msgs: DataFrame, key: str = "path") -> DataFrame:
    """Usage rows for ``operators.usage.settle``: one a record that carries usage; records without a
    message id are messages of their own."""
    u = lambda k: F.coalesce(F.try_variant_get("msg", f"$.usage.{k}", "long"), F.lit(0).cast("long"))
    split = F.schema_of_variant(F.try_variant_get("msg", "$.usage.cache_creation", "variant")).startswith("OBJECT")
    hour = F.when(split, u("cache_creation.ephemeral_1h_input_tokens")).otherwise(u("cache_creation_input_tokens"))
    short = F.when(split, u("cache_creation.ephemeral_5m_input_tokens")).otherwise(F.lit(0).cast("long"))
    rows = msgs.filter(F.schema_of_variant(F.try_variant_get("msg", "$.usage", "variant")).startswith("OBJECT"))
    blocks = F.try_variant_get("msg", "$.content", "array<variant>")
    chars = lambda kind, field: F.coalesce(F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.when(F.try_variant_get(b, "$.type", "string").isin(*kind), F.coalesce(F.length(F.coalesce(*[F.try_variant_get(b, f"$.{f}", "string") for f in field])), F.lit(0))).otherwise(0)), F.lit(0).cast("long"))
    tools = F.coalesce(F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.when(F.try_variant_get(b, "$.type", "string") == "tool_use", F.length(F.to_json(F.try_variant_get(b, "$.input", "variant")))).otherwise(0)), F.lit(0).cast("long"))
    mid = F.coalesce(F.try_variant_get("msg", "$.id", "string"), F.concat(F.lit("#"), F.col("idx").cast("string")))
    return rows.select(key, "idx", "t_ms", mid.alias("msg_id"), F.coalesce(F.try_variant_get("msg", "$.model", "string"), F.lit("unknown")).alias("model"), u("input_tokens").alias("inp"), u("cache_read_input_tokens").alias("cread"), short.alias("cw5"), hour.alias("cw1h"), u("output_tokens").alias("out_tok"), chars(("thinking", "redacted_thinking"), ("thinking", "data")).alias("ch_think"), chars(("text",), ("text",)).alias("ch_text"), tools.alias("ch_tool"))


def markers(msgs: DataFrame, key: str = "path") -> DataFrame:
    return msgs.filter("type = 'system' and subtype = 'compact_boundary'").select(key, "idx", "t_ms")


def turns(msgs: DataFrame, key: str = "path") -> DataFrame:
    """Roles for ``operators.segments.stalls``: close markers, assistants, and users who act themselves."""
    closing = (F.col("type") == "system") & F.col("subtype").isin("stop_hook_summary", "turn_duration")
    body = F.try_variant_get("msg", "$.content", "variant")
    acts = (F.schema_of_variant(body) == "STRING") & ~F.ltrim(F.try_variant_get(body, "$", "string")).startswith("<task-notification>")
    role = F.when(closing, "close").when((F.col("type") == "user") & F.coalesce(acts, F.lit(False)), "user").when(F.col("type").isin("user", "assistant"), "assistant").otherwise("other")
    return msgs.filter("t_ms is not null").select(key, "idx", "t_ms", role.alias("role"))


def trim_to_fork(records: DataFrame, marker: Column, key: str) -> DataFrame:
    """Records from the last one that ``marker`` holds for; all records of a key that has none."""
    fork = records.filter(marker).groupBy(key).agg(F.max("idx").alias("_fork"))
    return records.join(fork, key, "left").filter(F.col("idx") >= F.coalesce("_fork", F.lit(0))).drop("_fork")


def lookup(sessions: DataFrame, targets: list[str]) -> DataFrame:
    """For each target: how many ids of ``sessions`` (id, project, mtime) start with it, whether it is one, the
    projects that hold it in any case, and the session chosen: the only id, or where no id starts with the
    target the newest session of those projects."""
    wanted = F.broadcast(sessions.sparkSession.createDataFrame([(t,) for t in targets], "target string"))
    own, low = F.col("id").startswith(F.col("target")), F.lower("project").contains(F.lower("target"))
    hit = wanted.join(sessions, own | low, "left").withColumn("own", F.coalesce(own, F.lit(False))).withColumn("low", F.coalesce(low, F.lit(False)))
    n = F.count_if("own")
    newest = F.max_by(F.when(F.col("low"), F.col("id")), F.when(F.col("low"), F.struct("mtime", "id")))
    chosen = F.when(n == 1, F.max(F.when(F.col("own"), F.col("id")))).when(n == 0, newest)
    return hit.groupBy("target").agg(n.alias("matches"), (n == 1).alias("is_unique"), F.count_distinct(F.when(F.col("low"), F.col("project"))).alias("projects"), chosen.alias("chosen"))


def manifest(spark: SparkSession, root: str, endings: tuple[str, ...] = (".jsonl", ".meta.json", ".json", ".js")) -> DataFrame:
    """(session, path, relative_path, bytes): the record files of each session below ``root`` (project/session.jsonl
    and all that project/session/ holds), relative to the project's folder. Files are listed, not read."""
    listed = _listed(spark, root, files.found(spark, root)).select("path", F.col("size").alias("bytes"))
    # file:///x and file:/x are the same folder
    below = F.regexp_extract("path", f"^(?:file:/*)?/*{_quoted(root.removeprefix('file:').strip('/'))}/+(.*)$", 1)
    rest = F.substring_index(below, "/", -1)
    rows = listed.withColumn("_rel", below).withColumn("relative_path", F.regexp_replace("_rel", "^[^/]*/", "")).filter(F.col("_rel").contains("/"))
    own = F.array(*[F.lower(rest).endswith(e) for e in endings])
    session = F.regexp_replace(F.substring_index("relative_path", "/", 1), r"\.jsonl$", "")
    return rows.filter(F.exists(own, lambda x: x)).select(session.alias("session"), "path", "relative_path", "bytes")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


#: Keys whose strings are not text of a record (fixed values), and bounds of what is read.
NO_TEXT = ("thinking", "signature")
TEXT_DEPTH, TEXT_PARTS = 8, 181


def record_text(records: DataFrame, keys: list[str], col: str = "rec", raw: str = "value") -> DataFrame:
    """(keys, text): the strings of each record that are not blank, trimmed, one a line, in the order of the record; those under
    NO_TEXT keys or deeper than TEXT_DEPTH are left out, and those behind the first TEXT_PARTS. A VARIANT sorts its
    fields, so it gives the types, and the JSON text beside it the order. One narrow step for each level of nesting."""
    level = records.select(*keys, F.array().cast("array<int>").alias("_at"), F.col(col).alias("_v"), F.col(raw).alias("_t"))
    found = None
    for depth in range(TEXT_DEPTH + 1):
        kind = F.schema_of_variant("_v")
        own = level.filter(kind == "STRING").select(*keys, "_at", F.trim(F.regexp_replace(F.try_variant_get("_v", "$", "string"), r"^\s+|\s+$", "")).alias("_s")).filter("_s <> ''")
        found = own if found is None else found.unionByName(own)
        if depth < TEXT_DEPTH:
            named = ", ".join(f"t.`{k}`" for k in keys)
            skip = ", ".join(f"'{k}'" for k in NO_TEXT)
            below = level.withColumn("_m", F.when(kind.startswith("OBJECT"), F.from_json("_t", "map<string,string>"))).withColumn("_l", F.when(kind.startswith("ARRAY"), F.from_json("_t", "array<string>")))
            below = below.withColumn("_keys", F.json_object_keys(F.when(kind.startswith("OBJECT"), F.col("_t"))))
            level = records.sparkSession.sql(
                f"""SELECT {named}, array_append(t._at, CASE WHEN e.key IS NULL THEN e.pos ELSE CAST(array_position(t._keys, e.key) AS INT) END) AS _at, e.value AS _v,
                CASE WHEN e.key IS NULL THEN get(t._l, e.pos) ELSE try_element_at(t._m, e.key) END AS _t FROM {{t}} t, LATERAL variant_explode(t._v) e WHERE e.key IS NULL OR e.key NOT IN ({skip})""",
                t=below.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")),
            )
    parts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]), 1, TEXT_PARTS)
    return found.groupBy(*keys).agg(F.array_join(parts, "\n").alias("text"))


def workflow_runs(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(runs, agents) of the workflow files that ``glob`` names; broken files are skipped."""
    raw = spark.read.option("wholetext", "true").text(glob).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("w")).filter(F.schema_of_variant("w").startswith("OBJECT"))
    rid = F.coalesce(text("w", "$.runId"), F.regexp_replace("file", r"\.json$", ""))
    runs = raw.select(rid.alias("run_id"), F.coalesce(text("w", "$.workflowName"), rid).alias("name"), text("w", "$.taskId").alias("task_id"), F.substring(F.coalesce(text("w", "$.summary"), F.lit("")), 1, 240).alias("summary"), text("w", "$.status").alias("status"), text("w", "$.durationMs", "long").alias("duration_ms"), text("w", "$.totalTokens", "long").alias("tokens"), text("w", "$.totalToolCalls", "long").alias("tool_calls"))
    agents = raw.select(rid.alias("run_id"), F.explode(text("w", "$.workflowProgress", "array<variant>")).alias("a")).filter((text("a", "$.type") == "workflow_agent") & (F.coalesce(text("a", "$.agentId"), F.lit("")) != ""))
    return runs, agents.select("run_id", text("a", "$.agentId").alias("agent_id"), F.coalesce(text("a", "$.label"), F.lit("")).alias("label"), F.coalesce(text("a", "$.phaseTitle"), F.lit("")).alias("phase"), text("a", "$.model").alias("model"), text("a", "$.state").alias("state"), text("a", "$.tokens", "long").alias("tokens"), F.substring(F.coalesce(text("a", "$.promptPreview"), F.lit("")), 1, 400).alias("prompt"))


def subagents(spark: SparkSession, root: str) -> DataFrame:
    """(session, agent_id, wf_run, type, description, tool_id, transcript) of agent meta files; a meta file
    without a transcript still gives a row, an unreadable one doesn't."""
    metas = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.meta.json").option("wholetext", "true").text(root).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("m")).filter(F.schema_of_variant("m").startswith("OBJECT"))
    jsonl = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.jsonl").format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("transcript"))
    rows = metas.select(F.regexp_extract("file", r"([^/]+)/subagents/", 1).alias("session"), F.regexp_extract("file", r"agent-([^/]+)\.meta\.json$", 1).alias("agent_id"), F.nullif(F.regexp_extract("file", r"/subagents/workflows/([^/]+)/", 1), F.lit("")).alias("wf_run"), text("m", "$.agentType").alias("type"), text("m", "$.description").alias("description"), text("m", "$.toolUseId").alias("tool_id"), F.regexp_replace("file", r"\.meta\.json$", ".jsonl").alias("_t"))
    return rows.join(jsonl, F.col("_t") == F.col("transcript"), "left").drop("_t")
