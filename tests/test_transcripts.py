"""Transcripts of both formats, from files to facts; the tail source and the live state."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake.operators import documents, pairs, usage
from tracelake.sources import inventory, rollouts, transcripts
from tracelake.streaming import live
from tracelake.streaming.tail import TailReader, TailSource


def jsonl(path, records, tail=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records) + tail)


def assistant(ts, mid, out, content, **more):
    return {"type": "assistant", "timestamp": ts, "message": {"id": mid, "model": "m-1", "role": "assistant", "content": content, "usage": {"input_tokens": 10, "output_tokens": out, "cache_read_input_tokens": 2}, **more}}


SESSION = [
    {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s1", "promptSource": "typed", "message": {"role": "user", "content": " do \n it "}},
    "",
    "{half",
    assistant("2026-01-01T00:00:01Z", "m1", 2, [{"type": "thinking", "thinking": "hmm"}]),
    assistant("2026-01-01T00:00:02Z", "m1", 5, [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a/B.kt"}}]),
    {"type": "user", "timestamp": "2026-01-01T00:00:04Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "1\tx\n2\ty"}]}]}, "toolUseResult": {"file": {"numLines": 3, "startLine": 2, "totalLines": 9}}},
    assistant("2026-01-01T00:00:05Z", "m2", 7, [{"type": "tool_use", "id": "t2", "name": "MultiEdit", "input": {"file_path": "a", "edits": [{"old_string": "x", "new_string": "x\ny\nz"}, {"old_string": "a\nb", "new_string": ""}]}}], stop_reason="tool_use"),
    {"type": "user", "timestamp": "2026-01-01T00:00:05Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t2", "is_error": True, "content": ""}]}, "toolUseResult": {"stdout": "out", "stderr": "err"}},
    {"type": "system", "timestamp": "2026-01-01T00:00:06Z", "subtype": "compact_boundary"},
    {"type": "assistant", "timestamp": "bad", "message": {"id": "e", "model": "<synthetic>", "content": "API Error", "usage": {"output_tokens": 99}}},
]


@pytest.fixture(scope="module")
def session(tmp_path_factory):
    d = tmp_path_factory.mktemp("sessions")
    jsonl(f"{d}/projx/s1.jsonl", SESSION)
    jsonl(f"{d}/projx/s1/subagents/agent-a1.jsonl", SESSION[3:5])
    for name, body in {"agent-a1.meta.json": '{"agentType":"worker","toolUseId":"t1"}', "agent-a2.meta.json": '{"agentType":"lost"}', "agent-a3.meta.json": "{bad"}.items():
        with open(f"{d}/projx/s1/subagents/{name}", "w") as f:
            f.write(body)
    jsonl(f"{d}/projx/s1/workflows/wf_r1.json", [json.dumps({"workflowName": "build", "taskId": "T1", "workflowProgress": [{"type": "workflow_agent", "agentId": "a1", "label": "L", "state": "done"}, {"type": "other"}, {"type": "workflow_agent", "agentId": ""}]})])
    return str(d)


def test_session_files(spark, session):
    rec = transcripts.scan(spark, session).filter(F.col("path").endswith("/s1.jsonl"))
    assert [(x.line_no, x.idx) for x in rec.orderBy("idx").collect()] == [(0, 0), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6), (9, 7)]
    m = transcripts.messages(rec)
    assert [x.prompt for x in transcripts.prompts(m).collect()] == ["do it"]
    uses = transcripts.tool_uses(m).orderBy("idx").collect()
    assert [(x.name, x.brief, x.wlines, x.kind, x.val) for x in uses] == [("Read", "a/B.kt", None, None, None), ("MultiEdit", "a", 4, "delta", 1)]
    res = transcripts.tool_results(m)
    assert [(x.ok, x.output, x.read_start, x.read_n, x.read_total) for x in res.orderBy("idx").collect()] == [(True, "1\tx\n2\ty", 2, 3, 9), (False, "out\nerr", None, None, None)]
    paired = {x.tool_id: (x.ok, x.dur_ms) for x in pairs.pair(transcripts.tool_uses(m, "path"), res, key="path").collect()}
    assert paired == {"t1": (True, 2000), "t2": (False, 0)}
    settled = usage.settle(transcripts.usage(m), key="path").orderBy("idx").collect()
    assert [(x.msg_id, x.out_tok, x.ch_think, x.ch_text) for x in settled] == [("m1", 5, 3, 2), ("m2", 7, 0, 0)]
    assert transcripts.markers(m).count() == 1


def test_catalog_subagents_and_workflows(spark, session):
    got = [(x.project, x.format, x.session_id) for x in transcripts.catalog(spark, session).collect()]
    assert got == [("projx", "session", "s1")]
    agents = {x.agent_id: (x.session, x.type, x.tool_id, x.transcript is not None) for x in transcripts.subagents(spark, session).collect()}
    assert agents == {"a1": ("s1", "worker", "t1", True), "a2": ("s1", "lost", None, False)}
    runs, by_agent = transcripts.workflow_runs(spark, f"{session}/*/*/workflows/wf_*.json")
    assert [(x.run_id, x.name, x.task_id) for x in runs.collect()] == [("wf_r1", "build", "T1")]
    assert [(x.agent_id, x.label, x.state) for x in by_agent.collect()] == [("a1", "L", "done")]


def env(ts, kind, payload):
    return {"timestamp": f"2026-01-01T00:00:{ts:02d}Z", "type": kind, "payload": payload}


def tokens(ts, out, total_in=100):
    return env(ts, "event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": total_in, "cached_input_tokens": 1, "output_tokens": out, "reasoning_output_tokens": 0}}})


@pytest.fixture(scope="module")
def rollout(tmp_path_factory):
    """A weather station: the main rollout looks at a config and starts two helpers; one helper starts another. A rollout of
    another session names the main one as its parent."""
    d = str(tmp_path_factory.mktemp("rollouts"))
    call = lambda ts, name, cid, text: env(ts, "response_item", {"type": "custom_tool_call", "name": name, "call_id": cid, "input": text})
    output = lambda ts, cid, text: env(ts, "response_item", {"type": "custom_tool_call_output", "call_id": cid, "output": text})
    meta = lambda own, session, parent, depth, role: env(5, "session_meta", {"id": own, "session_id": session, "cwd": "/station", "thread_source": "subagent", "source": {"subagent": {"thread_spawn": {"parent_thread_id": parent, "depth": depth, "agent_path": f"/main/{role}"}}}})
    fork = env(6, "response_item", {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": transcripts.FORK_MARKER + "; yours is one part."}]})
    main = [
        env(0, "session_meta", {"id": "main", "session_id": "main", "cwd": "/station"}),
        tokens(1, 3, 10),
        "{ cut off",
        env(1, "event_msg", {"type": "user_message", "message": "count   the rain\nof May"}),
        call(2, "exec", "look", 'const a = 1; tools.shell_command({workdir: "/station/conf", command: "cat gauge.yaml"}); tools.shell_command({command: "date"})'),
        output(3, "look", [{"type": "input_text", "text": "unit: mm"}]),
        env(4, "turn_context", {"model": "big-1"}),
        env(4, "response_item", {"type": "function_call", "name": "spawn_agent", "call_id": "go", "arguments": '{"task_name":"valley"}'}),
        tokens(8, 41, 90),
    ]
    add = "*** Begin Patch\n*** Add File: valley/sum.ts\n+let mm = 0\n+export { mm }\n*** Delete File: old.ts\n-x\n*** End Patch"
    valley = [
        meta("valley", "main", "main", 1, "valley"),
        tokens(5, 41, 90),
        call(5, "exec", "before", "tools.shell_command({command: \"echo inherited\"})"),
        fork,
        env(6, "turn_context", {"model": "small-2"}),
        call(7, "exec", "write", "let text = " + json.dumps("no patch") + "; var text = " + json.dumps(add) + "; tools.apply_patch(text)"),
        output(8, "write", "Wall time 0.5 seconds\nExit code: 0\nWall time 1.25 seconds"),
        tokens(9, 60, 100),
    ]
    hill = [meta("hill", "main", "valley", 2, "valley/hill"), fork, call(7, "exec", "bad", 'tools.shell_command({command: "false"})'), output(9, "bad", "Exit code: 3")]
    other = [meta("far", "elsewhere", "main", 1, "far")]
    for name, rows in {"m-main": main, "v-valley": valley, "h-hill": hill, "o-other": other}.items():
        jsonl(f"{d}/2031/05/{name}.jsonl", rows)
    return d


def test_rollout_files(spark, rollout):
    rec = transcripts.scan(spark, rollout)
    metas = rollouts.files(rec)
    assert [(x.id, x.level) for x in rollouts.tree(metas).collect()] == [("main", 0), ("valley", 1), ("hill", 2)]
    rows = rollouts.local(rec, metas)
    name = lambda p: p.rsplit("/", 1)[1][0]
    assert {(name(x.path), x.model) for x in rollouts.model(rows).filter("model IS NOT NULL").collect()} == {("m", "big-1"), ("v", "small-2")}
    assert sorted((name(x.path), x.output_tokens, x.input_tokens) for x in rollouts.counters(rows).collect()) == [("m", 3, 10), ("m", 41, 90), ("v", 19, 10)]
    assert [x.prompt for x in rollouts.prompts(rows).collect()] == ["count the rain of May"]
    made = rollouts.calls(rows)
    assert {x.call_id: (x.idx, x.ok) for x in made.collect()} == {"look": (4, True), "go": (7, None), "write": (5, True), "bad": (2, False)}
    assert sorted(x.command for x in rollouts.shell_rows(made, metas).collect()) == ["cat gauge.yaml", "date", "false"]
    ops = documents.patch_ops(rollouts.patch_rows(made), ["source", "idx", "patch_no"]).orderBy("ord").collect()
    assert [(x.path, x.added, x.removed, x.val) for x in ops] == [("valley/sum.ts", 2, 0, 2), ("old.ts", 0, 1, -1)]
    assert [x.session_id for x in transcripts.catalog(spark, rollout).collect()] == ["main"]
    dec = spark.createDataFrame([('{"a":1}',), ("ls",), ("[1]",)], "raw string").select(rollouts.decoded(F.col("raw")).alias("d"))
    assert [x.d for x in dec.collect()] == ['{"a":1}', '{"input":"ls"}', '{"input":"[1]"}']


def test_inventory_counts_sources_under_main(spark, tmp_path):
    for path, body in {"m/src/main/A.kt": "a\nb\n", "m/src/main/l.xml": "x", "m/src/test/T.kt": "t", "m/build/src/main/G.kt": "g", "m/src/main/n.txt": "n"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(body)
    files = inventory.inventory(inventory.scan(spark, str(tmp_path)))
    assert sorted((x.path.rsplit("/", 1)[1], x.n_lines, x.is_code) for x in files.collect()) == [("A.kt", 2, True), ("l.xml", 1, False)]
    assert tuple(inventory.totals(files).first()) == (2, 3, 1, 2)
    assert tuple(inventory.totals(files, most=1).first()) == (None,) * 4


def take(reader, start):
    end = reader.latestOffset()
    return end, [(r[1], r[3]) for p in reader.partitions(start, end) for r in reader.read(p)]


def test_tail_delivers_whole_lines_once_and_starts_over(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a":1}\n{"b"')
    reader = TailReader(f"{tmp_path}/*.jsonl")
    o1, got = take(reader, reader.initialOffset())
    assert got == [(0, '{"a":1}')]
    with path.open("a") as f:
        f.write(':2}\n')
    o2, got = take(reader, o1)
    assert got == [(0, '{"b":2}')]
    (tmp_path / "b.jsonl").write_text("late\n")
    again = TailReader(f"{tmp_path}/*.jsonl")  # a restart: offsets come from the checkpoint
    again.partitions(o1, o2)
    o3, got = take(again, o2)
    assert got == [(0, "late")]
    path.write_text("new\n")
    assert take(again, o3)[1] == [(1, "new")]


def test_live_state_resumes_and_equals_the_batch(spark, tmp_path):
    spark.dataSource.register(TailSource)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    jsonl(f"{src}/7.txt", SESSION[:5])

    def drain():
        rows = spark.readStream.format("transcript_tail").option("pattern", f"{src}/*.txt").load()
        rows = rows.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("session_id"), "generation", F.lpad(F.col("byte").cast("string"), 20, "0").alias("at"), "line")
        live.run(live.reduce(rows), out)
        return live.latest(spark, out).first()

    a = drain()
    assert (a.records, a.tool_calls, a.open_tools, a.prompts, a.output_tokens, a.status) == (3, 1, 1, 1, 5, "running")
    with open(f"{src}/7.txt", "a") as f:
        f.write("".join(json.dumps(r) + "\n" for r in SESSION[5:]))
        f.write(json.dumps(assistant("2026-01-01T00:00:09Z", "m3", 3, [{"type": "text", "text": "done"}])) + "\n")
    b = drain()
    assert (b.records, b.tool_calls, b.open_tools, b.failed, b.output_tokens, b.covered_lines, b.status) == (9, 2, 0, 1, 15, 3, "waiting")
    m = transcripts.messages(transcripts.scan(spark, src))
    batch = usage.settle(transcripts.usage(m), key="path").agg(F.sum("out_tok").alias("o")).first().o
    assert batch == b.output_tokens
    assert [x.event for x in live.events_feed(m, "path").orderBy("idx").collect()] == ["prompt", "write", "compact"]


def test_live_state_starts_again_when_the_file_is_replaced(spark, tmp_path):
    spark.dataSource.register(TailSource)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    use = lambda i: [{"type": "tool_use", "id": i, "name": "Read", "input": {"file_path": "a"}}]
    jsonl(f"{src}/7.txt", [assistant("2026-01-01T00:00:01Z", "m1", 10, use("t1")), "{broken", assistant("2026-01-01T00:00:02Z", "m2", 20, use("t1")), assistant("2026-01-01T00:00:03Z", "m3", 10, use("t2"))])

    def drain():
        rows = spark.readStream.format("transcript_tail").option("pattern", f"{src}/*.txt").load()
        rows = rows.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("session_id"), "generation", F.lpad(F.col("byte").cast("string"), 20, "0").alias("at"), "line")
        live.run(live.reduce(rows), out)
        x = live.latest(spark, out).first()
        return x.records, x.output_tokens, x.tool_calls, x.open_tools, x.bad_lines, x.generation

    assert drain() == (3, 40, 2, 2, 1, 0)  # the second use of an id is ignored
    jsonl(f"{src}/7.txt", [assistant("2026-01-01T00:00:09Z", "m1", 10, [{"type": "text", "text": "new"}])])
    assert drain() == (1, 10, 0, 0, 0, 1)


def test_agents_link_by_workflow_call_and_time(spark):
    from tracelake.operators import agents

    segs = spark.createDataFrame([(1, 0, "plan", 0, 10), (1, 1, "wf:b", 11, 20)], "session_id int, seg_no long, stage string, start_ms long, end_ms long")
    calls = spark.createDataFrame([(1, "t1", 3, 0, "plan", True)], "session_id int, tool_id string, idx long, seg_no long, stage string, ok boolean")
    a = spark.createDataFrame([(1, "x", "t1", 15, "own"), (1, "y", "none", 15, "own"), (1, "z", "t1", 5, "own"), (1, "w", None, 99, "own")], "session_id int, agent_id string, tool_id string, start_ms long, label string")
    wf = spark.createDataFrame([("z", "named", "done", "wf:b")], "agent_id string, wf_label string, state string, stage string")
    got = {x.agent_id: (x.label, x.seg_no, x.stage, x.status) for x in agents.link(a, calls, segs, wf).collect()}
    assert got == {"x": ("own", 0, "plan", "completed"), "y": ("own", 1, "wf:b", "unknown"), "z": ("named", 1, "wf:b", "done"), "w": ("own", None, None, "unknown")}
    tree = spark.createDataFrame([("r", None, 0), ("k", "r", 1), ("g", "k", 2)], "id string, parent string, level int")
    own = spark.createDataFrame([("r", "spec"), ("g", "build")], "id string, stage string")
    assert {x.id: x.stage for x in agents.inherit_stage(tree, own).collect()} == {"r": "spec", "k": "spec", "g": "build"}
    kids = spark.createDataFrame([("p", "k", "/root/worker"), ("p", "q", "/root/none")], "parent string, id string, agent_path string")
    made = spark.createDataFrame([("p", 5, "do worker"), ("p", 2, "the worker task")], "parent string, idx long, brief string")
    assert {x.id: x.idx for x in agents.spawned(kids, made).collect()} == {"k": 2, "q": None}
