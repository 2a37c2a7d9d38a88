"""Live state of whole sessions: main transcripts, sub-agents, coverage, events and metadata.

One streaming query chains three stateful operators over landed lines:

1. by file: counters, status, stage and usage of a stream; it gives its state after each batch, its events, and the source
   lines that its results show; relative paths are below the working folder that the file names. A file of a new generation starts again and takes back the lines it had shown.
2. by (session, source file): the union of the shown lines of all streams, clipped to the file's length in the inventory.
3. by session: the latest state of each stream, covered lines, and a ring of the last ``RING`` events.

Its output, one table a batch, is written over if the batch is repeated, so every event is in it once.
``publish`` joins the newest session states with the metadata (files that are written over in place, read again when
their time changes; half-written ones keep what was known), and adds the rows that changed to the snapshot with the
next version. If nothing changed, there is no new version.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.functions import paths
from tracelake.operators.tables import cut
from tracelake.streaming import landing
from tracelake.streaming.shared import Held

RING = 80
#: Parts among which the rows without a source file are dealt in the join with the inventory.
SPREAD = 1 << 20
ROW = "session_id string, source string, n_lines long, is_code boolean, stream string, agent_id string, kind string, generation long, at string, body string"
OUT = "session_id string, kind string, at string, body string"
_ROW, _OUT = ([c.split()[0] for c in x.split(", ")] for x in (ROW, OUT))
#: Names and texts of the record format (fixed values).
EDITS, LAUNCHES = ("Write", "Edit", "MultiEdit"), ("Agent", "Task")
TURN_ENDS = ("stop_hook_summary", "turn_duration")
STOPS = ("end_turn", "stop_sequence")
COUNTERS = ("records", "tool_calls", "failed", "open_tools", "prompts", "output_tokens", "input_tokens", "cache_read_tokens", "bad_lines")


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _number(x) -> int:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0


def _text(content) -> str:
    if isinstance(content, str):
        return content
    return "\n".join(b["text"] for b in content if isinstance(b, dict) and isinstance(b.get("text"), str)) if isinstance(content, list) else ""


def _workflow(script: str) -> str:
    """The stage of a workflow: wf: and the quoted text behind the first field ``name`` of its script; empty without one."""
    parts = re.split("([\"'])", script)
    for i in range(len(parts) - 2):
        if parts[i].rstrip().endswith(":") and parts[i].rstrip(" :\n\t").endswith("name") and parts[i + 2]:
            return "wf:" + parts[i + 2]
    return ""


def shown_spans(told, body: str) -> list[list[int]]:
    """[start, n] of the lines that a Read result shows: as told, else by the numbers before tabs, else its lines from 1 on."""
    file = _dict(_dict(told).get("file"))
    if _number(file.get("numLines")) > 0:
        return [[_number(file.get("startLine")) or 1, _number(file["numLines"])]]
    heads = [head for head, tab, _ in (line.partition("\t") for line in body.split("\n")) if tab]
    numbered = [[int(h), 1] for h in heads if h.strip().isdecimal() and len(h) <= 8 + len(h.strip())]
    return numbered or ([[1, body.count("\n") + 1]] if body else [])


def _as_row(names: list[str], values) -> Row:
    return Row(**dict(zip(names, values, strict=True)))


class StreamState(StatefulProcessor):
    """The state of one transcript file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.doc = handle.getValueState("doc", "doc string")
        self.states = (
            handle.getMapState("usage", "msg string", "out long, inp long, cache long"),
            handle.getMapState("calls", "id string", "name string, path string, done boolean"),
            handle.getMapState("shown", "source string", "n long"),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = sorted(rows, key=lambda r: (r.generation, r.byte))
        session, agent = got[0].session_id, got[0].agent_id
        self.out: list[tuple] = []
        self.name = (session, key[0], agent)
        old = self.doc.get()
        c = json.loads(old[0]) if old is not None else None
        self.usage, self.calls, self.shown = (Held(state, c is None) for state in self.states)
        if c is None:
            c = self._fresh(agent, 0)
            if agent:
                self._event(c, "agent", f"found {agent[:8]}", None)
        newest = got[-1].generation
        if newest > c["generation"]:
            self.calls.clear()
            self.usage.clear()
            c = self._fresh(agent, newest)
            for (source,) in self.shown.keys():
                self._row(c, "span", source, None, "[]")
            self.shown.clear()
            self._event(c, "reset", "transcript was replaced", None)
        for line in (r.line for r in got if r.generation == newest):
            try:
                rec = json.loads(line)
            except ValueError:
                rec = None
            if isinstance(rec, dict):
                self._record(rec, c)
            elif line.strip():
                c["bad_lines"] += 1
                self._event(c, "error", "a line is no record", None)
        for held in (self.usage, self.calls, self.shown):
            held.write()
        self.doc.update((json.dumps(c),))
        self._row(c, "state", "", c["last_ts"], json.dumps(c))
        yield from (_as_row(_ROW, x) for x in self.out)

    def _fresh(self, agent: str, generation: int) -> dict:
        start = {"status": "running" if agent else "idle", "stage": "session", "model": None, "cwd": None, "first_ts": None, "last_ts": None}
        return {"generation": generation, **dict.fromkeys(COUNTERS, 0), **start, "tools": {}, "read_files": 0, "write_files": []}

    def _row(self, c: dict, kind: str, source: str, at: str | None, body: str) -> None:
        session, path, agent = self.name
        self.out.append((session, source, None, None, path, agent, kind, c["generation"], at, body))

    def _event(self, c: dict, kind: str, text: str, at: str | None, **more) -> None:
        self._row(c, "event", "", at or c["last_ts"], json.dumps({"kind": kind, "text": text, **more}))

    def _stage(self, c: dict, stage: str, at) -> None:
        if stage and stage != c["stage"]:
            c["stage"] = stage
            if not self.name[2]:
                self._event(c, "stage", stage, at)

    def _record(self, rec: dict, c: dict) -> None:
        c["records"] += 1
        at = rec.get("timestamp") if isinstance(rec.get("timestamp"), str) else None
        if at:
            c["first_ts"], c["last_ts"] = min(at, c["first_ts"] or at), max(at, c["last_ts"] or at)
        c["cwd"] = c["cwd"] or rec.get("cwd")
        msg, kind = _dict(rec.get("message")), rec.get("type")
        model = msg.get("model") if isinstance(msg.get("model"), str) else ""
        if model and not model.startswith("<"):
            c["model"] = c["model"] or model
        self._usage(msg, model, c)
        content = msg.get("content")
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
        for b in blocks:
            if b.get("type") == "tool_use":
                self._call(b, at, c)
            elif b.get("type") == "tool_result":
                self._result(b, rec.get("toolUseResult"), c)
        text, stop = _text(content), msg.get("stop_reason")
        if self.name[2]:
            self._agent_status(kind, msg, text, stop, any(b.get("type") == "tool_use" for b in blocks), at, c)
            return
        self._stage(c, str(rec.get("attributionSkill") or "").split(":")[-1], at)
        if kind == "user" and rec.get("promptSource") == "typed" and text.strip():
            c["prompts"] += 1
            c["status"] = "running"
            self._event(c, "prompt", " ".join(text.split())[:100], at)
        elif kind == "system" and rec.get("subtype") in TURN_ENDS:
            c["status"] = "waiting"
        elif kind == "assistant" and msg:
            c["status"] = "waiting" if stop == "end_turn" else "running"

    def _agent_status(self, kind, msg: dict, text: str, stop, calls: bool, at, c: dict) -> None:
        low = text.lower()
        if "request interrupted" in low or "stopped by the user" in low:
            c["status"] = "interrupted"
        elif "api error" in low and "connection" in low:
            if c["status"] != "failed":
                self._event(c, "error", "agent failed", at)
            c["status"] = "failed"
        elif kind == "assistant" and msg and (stop in STOPS or (stop is None and text.strip() and not calls)):
            c["status"] = "completed"
            if stop in STOPS:  # an old record without a reason may be followed by another turn
                self._event(c, "agent", f"completed {self.name[2][:8]}", at)
        elif kind in ("assistant", "user"):
            c["status"] = "running"

    def _usage(self, msg: dict, model: str, c: dict) -> None:
        use = msg.get("usage")
        if not isinstance(use, dict) or model.startswith("<"):
            return
        mid = (str(msg.get("id") or f"#{c['records']}"),)
        now = tuple(_number(use.get(k)) for k in ("output_tokens", "input_tokens", "cache_read_input_tokens"))
        was = self.usage.get(mid) or (0, 0, 0)
        self.usage.put(mid, now)
        for k, a, b in zip(("output_tokens", "input_tokens", "cache_read_tokens"), now, was, strict=True):
            c[k] += a - int(b)

    def _call(self, block: dict, at, c: dict) -> None:
        key, name, given = (str(block.get("id")),), str(block.get("name") or "unknown"), _dict(block.get("input"))
        if block.get("id") and self.calls.get(key):
            return
        path = given.get("file_path") or given.get("path")
        path = path if isinstance(path, str) else ""
        self.calls.put(key, (name, path, False))
        c["tool_calls"] += 1
        c["open_tools"] += 1
        c["tools"][name] = c["tools"].get(name, 0) + 1
        if name == "Skill":
            self._stage(c, str(given.get("skill") or "").split(":")[-1], at)
        elif name == "Workflow":
            self._stage(c, _workflow(str(given.get("script") or "")), at)
        elif name in EDITS and path:
            target = _absolute(path, c["cwd"])
            if target not in c["write_files"]:
                c["write_files"].append(target)
            self._event(c, "write", f"{name} {target.rsplit('/', 1)[-1]}", at)
        elif name in LAUNCHES:
            self._event(c, "agent", f"launched {given.get('description') or given.get('subagent_type') or 'agent'}", at)

    def _result(self, block: dict, told, c: dict) -> None:
        key = (str(block.get("tool_use_id")),)
        name, path, done = self.calls.get(key) or ("", "", True)
        if done:
            return
        self.calls.put(key, (name, path, True))
        c["open_tools"] -= 1
        if block.get("is_error"):
            c["failed"] += 1
        elif name == "Read" and path:
            source, spans = _absolute(path, c["cwd"]), shown_spans(told, _text(block.get("content")))
            if spans:
                if not self.shown.get((source,)):
                    self.shown.put((source,), (1,))
                    c["read_files"] += 1
                self._row(c, "span", source, c["last_ts"], json.dumps(spans))

    def close(self) -> None:
        pass


def _absolute(path: str, cwd: str | None) -> str:
    path = path.replace("\\", "/")
    return path if path.startswith("/") or path[1:2] == ":" or not cwd else cwd.replace("\\", "/").rstrip("/") + "/" + path


def merged(spans: list[list[int]]) -> list[list[int]]:
    """[start, end) spans, sorted and joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Coverage(StatefulProcessor):
    """Shown lines of one source file in one session, by stream; other rows (source '') pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "stream string", "generation long, spans string")
        self.told = handle.getValueState("told", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not key[1]:
            yield from rows
            return
        got = list(rows)
        told = self.told.get()
        held = {} if told is None else {k[0]: tuple(v) for k, v in self.spans.iterator()}
        changed = {}
        for r in sorted(got, key=lambda r: r.generation):
            old = held.get(r.stream, (0, "[]"))
            if r.generation < old[0]:
                continue
            kept = json.loads(old[1]) if r.generation == old[0] else []
            new = merged([*kept, *([max(a, 1), a + n] for a, n in json.loads(r.body) if n > 0 and a + n > 1)])
            held[r.stream] = changed[r.stream] = (r.generation, json.dumps(new))
        for stream, value in changed.items():
            self.spans.updateValue((stream,), value)
        top = got[0].n_lines
        every = merged([s for _, spans in held.values() for s in json.loads(spans)])
        n = -1 if top is None else sum(max(0, min(b, top + 1) - a) for a, b in every)
        if told is None or told[0] != n:
            self.told.update((n,))
            yield _as_row(_ROW, [{"kind": "covered", "body": str(n)}.get(c, got[-1][c]) for c in _ROW])

    def close(self) -> None:
        pass


class SessionState(StatefulProcessor):
    """State of a session over its streams. Gives its events, and one row with its state after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streams = handle.getMapState("streams", "stream string", "agent string, doc string")
        self.covered = handle.getMapState("covered", "source string", "n long, code boolean")
        self.ring = handle.getValueState("ring", "events string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got, old = list(rows), self.ring.get()
        streams = {} if old is None else {k[0]: tuple(v) for k, v in self.streams.iterator()}
        covered = {} if old is None else {k[0]: tuple(v) for k, v in self.covered.iterator()}
        now = {r.stream: (r.agent_id or "", r.body) for r in got if r.kind == "state"}
        seen = {r.source: (int(r.body), bool(r.is_code)) for r in got if r.kind == "covered"}
        for state, changed in ((self.streams, now), (self.covered, seen)):
            for name, value in changed.items():
                state.updateValue((name,), value)
        new = [(r.at or "", {"at": r.at, "stream": r.stream, **json.loads(r.body)}) for r in got if r.kind == "event"]
        new = [e for _, e in sorted(new, key=lambda x: x[0])]
        ring = ([*json.loads(old[0]), *new] if old is not None else new)[-RING:]
        self.ring.update((json.dumps(ring),))
        out = [(key[0], "event", e["at"], json.dumps(e)) for e in new]
        out.append((key[0], "state", None, json.dumps(self._summary(ring, streams | now, covered | seen))))
        yield from (_as_row(_OUT, x) for x in out)

    def _summary(self, ring: list[dict], streams: dict, covered: dict) -> dict:
        docs = [(agent, json.loads(doc)) for agent, doc in streams.values()]
        main = next((d for agent, d in docs if not agent), None)
        tools: dict[str, int] = {}
        for _, d in docs:
            for name, n in d["tools"].items():
                tools[name] = tools.get(name, 0) + n
        seen = [(n, code) for n, code in covered.values() if n > 0]
        stamps = [[d[k] for _, d in docs if d[k]] for k in ("first_ts", "last_ts")]
        agents = [{"agent_id": a, **{k: d[k] for k in ("status", "stage", "model", "output_tokens", "read_files", "last_ts")}, "tool_uses": d["tool_calls"], "write_files": len(d["write_files"])} for a, d in docs if a]
        return {
            **{k: sum(d[k] for _, d in docs) for k in COUNTERS},
            "main_status": main and main["status"], "stage": main["stage"] if main else "session",
            "started_at": min(stamps[0], default=None), "ended_at": max(stamps[1], default=None),
            "write_files": len({f for _, d in docs for f in d["write_files"]}), "generation": max((d["generation"] for _, d in docs), default=0),
            "covered_files": len(seen), "covered_lines": sum(n for n, _ in seen), "covered_code_files": sum(c for _, c in seen), "covered_code_lines": sum(n for n, c in seen if c),
            "tools": [{"name": k, "n": tools[k]} for k in sorted(tools)], "agents": sorted(agents, key=lambda x: x["agent_id"]), "events": ring,
        }

    def close(self) -> None:
        pass


def names(path: Column) -> tuple[Column, Column]:
    """Session and agent ('' for the main transcript) of a file, project/session.jsonl or project/session/subagents/.../agent-id.jsonl."""
    inside = F.regexp_extract(path, r"/([^/]+)/(?:subagents|workflows)/", 1)
    own = F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)
    return F.when(inside != "", inside).otherwise(own), F.regexp_extract(path, r"/subagents/(?:.*/)?agent-([^/]+?)(?:\.meta)?\.jsonl?$", 1)


def reduce(lines: DataFrame, inventory: DataFrame | None = None, named: tuple[Column, Column] | None = None) -> DataFrame:
    """The chained stateful operators over streaming lines (path, generation, byte, line); ``inventory`` has path, n_lines,
    is_code. ``named`` are session and agent of a path, if not those of ``names``."""
    session, agent = named or names(F.col("path"))
    rows = lines.select("path", session.alias("session_id"), agent.alias("agent_id"), F.col("generation").cast("long").alias("generation"), "byte", "line")
    kind = {"outputMode": "append", "timeMode": "none"}
    rows = rows.groupBy("path").transformWithState(StreamState(), ROW, **kind)
    if inventory is not None:
        known = inventory.groupBy(F.col("path").alias("source")).agg(F.max("n_lines").cast("long").alias("_n"), F.max("is_code").alias("_code"))
        # merged and not broadcast, as the inventory grows with the input (the estimate is of its compressed file); rows without a source are dealt by stream
        spread = F.when(F.col("source") == "", F.pmod(F.xxhash64("stream"), F.lit(SPREAD)) + 1).otherwise(0)
        rows = rows.withColumn("_s", spread.cast("long")).join(known.withColumn("_s", F.lit(0).cast("long")).hint("merge"), ["source", "_s"], "left")
        rows = rows.withColumn("n_lines", F.col("_n")).withColumn("is_code", F.col("_code")).select(*_ROW)
    else:  # without one, every line counts
        rows = rows.withColumn("n_lines", F.lit((1 << 40)).cast("long")).withColumn("is_code", paths.is_code(F.col("source")))
    rows = rows.groupBy("session_id", "source").transformWithState(Coverage(), ROW, **kind)
    return rows.groupBy("session_id").transformWithState(SessionState(), OUT, **kind)


def drain(stream: DataFrame, folder: str) -> None:
    """Runs ``stream`` to the end of its input; batch n goes to ``folder``/out/batch=n."""
    spark = stream.sparkSession
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    try:
        stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if keep is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", keep)


#: Files that say something of agents.
NOTES = r"/(?:agent-[^/]*\.meta|wf_[^/]*)\.json$"
META = "file string, mtime timestamp, session_id string, agent_id string, desc string, agent_type string, workflow string, state string, model string"


def metadata(spark: SparkSession, root: str, folder: str, found: DataFrame | None = None) -> DataFrame:
    """(META) what agent meta files and workflow files say. Files written since the last time are read again; those that
    don't parse are being written, so what they said before stays. Tasks list and read them (``found`` is a listing that the caller
    has already): Spark's text reader would keep the status of every file below ``root`` in the driver, transcripts too."""
    last = landing.last_version(spark, f"{folder}/meta")
    known = spark.read.schema(META).parquet(f"{folder}/meta/version={last}") if last >= 0 else spark.createDataFrame([], META)
    files = landing.listing(spark, root, NOTES) if found is None else found.filter(F.col("path").rlike(NOTES))
    old = known.groupBy(F.col("file").alias("path")).agg(F.max("mtime").alias("_mtime"))
    files = cut(files.join(old, "path", "left").filter(F.col("_mtime").isNull() | (F.col("_mtime") != F.timestamp_seconds("mtime"))), "notes")
    n = files.count()
    if not n:
        return known
    raw = landing.texts(files, n).select(F.col("path").alias("file"), F.timestamp_seconds("mtime").alias("mtime"), "value")
    fresh = raw.withColumn("m", F.try_parse_json("value")).filter(F.schema_of_variant("m").startswith("OBJECT"))
    get = lambda v, p: F.try_variant_get(v, p, "string")
    session, agent = names(F.col("file"))
    fresh = cut(fresh.select("file", "mtime", session.alias("session_id"), agent.alias("agent_id"), "m"), "metadata")
    none = F.lit(None).cast("string")
    metas = fresh.filter("agent_id <> ''").select("file", "mtime", "session_id", "agent_id", F.substring(get("m", "$.description"), 1, 240).alias("desc"), get("m", "$.agentType").alias("agent_type"), none.alias("workflow"), none.alias("state"), none.alias("model"))
    run = F.coalesce(get("m", "$.workflowName"), get("m", "$.runId"), F.regexp_extract("file", r"([^/]+)\.json$", 1))
    flows = fresh.filter("agent_id = ''").select("file", "mtime", "session_id", run.alias("workflow"), F.explode_outer(F.try_variant_get("m", "$.workflowProgress", "array<variant>")).alias("a"))
    worker = F.when(get("a", "$.type") == "workflow_agent", F.coalesce(get("a", "$.agentId"), F.lit(""))).otherwise("")  # '' holds the file's time
    flows = flows.select("file", "mtime", "session_id", worker.alias("agent_id"), F.substring(F.nullif(get("a", "$.label"), F.lit("")), 1, 240).alias("desc"), none.alias("agent_type"), "workflow", F.lower(F.coalesce(get("a", "$.state"), F.lit("running"))).alias("state"), get("a", "$.model").alias("model"))
    new = metas.unionByName(flows)
    if fresh.isEmpty():
        return known
    now = known.join(fresh.select("file").distinct(), "file", "left_anti").unionByName(new)
    now.write.mode("overwrite").parquet(f"{folder}/meta/version={last + 1}")
    return spark.read.schema(META).parquet(f"{folder}/meta/version={last + 1}")


_AGENT = "agent_id string, status string, stage string, model string, output_tokens long, read_files long, last_ts string, tool_uses long, write_files long"
_LONGS = (*COUNTERS, "write_files", "generation", "covered_files", "covered_lines", "covered_code_files", "covered_code_lines")
BODY = ", ".join(f"{c} long" for c in _LONGS) + f", main_status string, stage string, started_at string, ended_at string, tools array<struct<name: string, n: long>>, agents array<struct<{_AGENT.replace(' ', ': ').replace(',: ', ', ')}>>, events array<struct<at: string, stream: string, kind: string, text: string>>"


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each session, as the stream left it."""
    rows = spark.read.schema(OUT + ", batch long").parquet(f"{folder}/out").filter("kind = 'state'")
    return rows.groupBy("session_id").agg(F.max_by("body", "batch").alias("body")).select("session_id", F.from_json("body", BODY).alias("b")).select("session_id", "b.*")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, at, stream, kind, text): every event once."""
    rows = spark.read.schema(OUT + ", batch long").parquet(f"{folder}/out").filter("kind = 'event'")
    return rows.select("session_id", F.from_json("body", "at string, stream string, kind string, text string").alias("e")).select("session_id", "e.*")


def with_metadata(now: DataFrame, meta: DataFrame) -> DataFrame:
    """Session states with labels and workflow states of agents, the session's status and counts of agents by status;
    running agents come first, then by label."""
    flow = meta.filter("workflow is not null and agent_id <> ''").groupBy("session_id", "agent_id").agg(F.max_by(F.struct("desc", "workflow", "state", "model"), F.struct("mtime", "file")).alias("w"))
    own = meta.filter("workflow is null").groupBy("session_id", "agent_id").agg(F.max_by(F.struct("desc", "agent_type"), F.struct("mtime", "file")).alias("o"))
    a = now.select("session_id", F.explode("agents").alias("a")).select("session_id", "a.*").join(flow, ["session_id", "agent_id"], "left").join(own, ["session_id", "agent_id"], "left")
    said = F.when(F.col("w.state").isin("done", "completed"), "completed").when(F.col("w.state").isin("failed", "error"), "failed").when(F.col("w.state").isin("cancelled", "canceled"), "interrupted").otherwise("running")
    in_flow = F.col("w").isNotNull()
    a = a.select(
        "session_id", "agent_id", F.coalesce("w.desc", F.nullif(F.col("o.desc"), F.lit("")), "agent_id").alias("desc"), F.col("o.agent_type").alias("type"),
        F.when(in_flow, said).otherwise(F.col("status")).alias("status"), F.when(in_flow, F.concat(F.lit("wf:"), "w.workflow")).otherwise(F.col("stage")).alias("stage"), F.coalesce("w.model", "model").alias("model"),
        "tool_uses", "output_tokens", "read_files", "write_files", "last_ts",
    )
    cols = [c for c in a.columns if c != "session_id"]
    counts = a.groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("agent_counts"))
    first = F.struct((F.col("status") != "running").alias("_r"), "desc", "agent_id", F.struct(*cols).alias("x"))
    lists = a.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["x"]).alias("agents"), F.count_if(F.col("status") == "running").alias("_running"))
    out = now.drop("agents").join(lists, "session_id", "left").join(counts, "session_id", "left")
    status = F.when(F.coalesce("_running", F.lit(0)) > 0, "running").when(F.col("main_status").isin("running", "waiting"), F.col("main_status")).otherwise("idle")
    return out.withColumn("status", status).drop("_running")


def publish(spark: SparkSession, root: str, folder: str, found: DataFrame | None = None) -> int:
    """Adds the rows that changed to the snapshot; its version, which stays if nothing did. ``found`` as in ``metadata``."""
    last = landing.last_version(spark, f"{folder}/snapshot")
    now = with_metadata(states(spark, folder), metadata(spark, root, folder, found))
    now = now.withColumn("digest", F.sha2(F.to_json(F.struct(*now.columns)), 256))
    if last >= 0:
        now = now.join(snapshot(spark, folder).select("session_id", F.col("digest").alias("_old")), "session_id", "left").filter("_old is null or _old <> digest").drop("_old")
    now = cut(now, "changed")
    if now.isEmpty():
        return last
    now.write.mode("overwrite").parquet(f"{folder}/snapshot/version={last + 1}")
    return last + 1


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each session with the version that wrote it."""
    rows = spark.read.parquet(f"{folder}/snapshot")
    w = Window.partitionBy("session_id").orderBy(F.desc("version"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def advance(spark: SparkSession, root: str, folder: str, inventory: DataFrame | None = None, *, pattern: str = r"\.jsonl$", max_bytes: int | None = None, named: tuple[Column, Column] | None = None) -> int:
    """One step of following ``root``: list, poll, reduce what was landed, publish. The version of the snapshot."""
    found = landing.listing(spark, root, f"(?:{pattern})|(?:{NOTES})")
    landing.poll(spark, root, folder, pattern=pattern, max_bytes=max_bytes, found=found)
    drain(reduce(landing.lines(spark, folder), inventory, named), folder)
    return publish(spark, root, folder, found)
