"""Live sessions: agents and their states, stages, events once each, coverage, metadata and versions, across restarts."""

import json
import os

import pytest

from tracelake.operators import lineage
from tracelake.streaming import landing, sessions


def add(path, *records, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def say(ts, mid, content, **more):
    return {"type": "assistant", "timestamp": f"2026-02-01T00:00:{ts:02d}Z", "message": {"id": mid, "model": "m-1", "content": content, "usage": {"output_tokens": 10, "input_tokens": 1}, **more}}


def use(name, tid, **given):
    return {"type": "tool_use", "id": tid, "name": name, "input": given}


def result(ts, tid, told=None, content="", **more):
    return {"type": "user", "timestamp": f"2026-02-01T00:00:{ts:02d}Z", "message": {"content": [{"type": "tool_result", "tool_use_id": tid, "content": content, **more}]}, "toolUseResult": told}


def prompt(ts, text):
    return {"type": "user", "timestamp": f"2026-02-01T00:00:{ts:02d}Z", "promptSource": "typed", "cwd": "/w", "message": {"content": text}}


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame([("/w/A.kt", 10, True), ("/w/l.xml", 5, False)], "path string, n_lines long, is_code boolean")


def state(spark, out):
    return {r.session_id: r for r in sessions.snapshot(spark, out).collect()}


def kinds(spark, out):
    return sorted((r.kind, r.text) for r in sessions.events(spark, out).collect())


def test_a_session_over_three_steps(spark, inventory, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    main, sub = f"{src}/p/s1.jsonl", f"{src}/p/s1/subagents"
    add(main, prompt(1, " go \n on"), say(2, "a", [use("Skill", "k", skill="x:spec-plan"), use("Read", "r1", file_path="A.kt")]), result(3, "r1", {"file": {"startLine": 8, "numLines": 9}}))
    add(f"{sub}/agent-ab12.jsonl", say(4, "b", [use("Edit", "e", file_path="out/x.ts"), use("Read", "r2", file_path="\\w\\A.kt")]), result(5, "r2", None, "7\tseven\n8\teight"))
    add(f"{sub}/workflows/w/agent-cd34.jsonl", say(5, "c", [{"type": "text", "text": "working"}], stop_reason="tool_use"))
    add(f"{src}/p/s2.jsonl", say(1, "z", [{"type": "text", "text": "hi"}], stop_reason="end_turn"))
    assert sessions.advance(spark, src, out, inventory) == 0
    s = state(spark, out)
    a = s["s1"]
    assert (a.status, a.stage, a.records, a.tool_calls, a.open_tools, a.prompts, a.output_tokens, a.input_tokens) == ("running", "spec-plan", 6, 4, 2, 1, 30, 3)
    assert (a.covered_lines, a.covered_files, a.covered_code_lines, a.write_files) == (4, 1, 4, 1)  # 7 .. 10, clipped
    assert [(x.agent_id, x.desc, x.status) for x in a.agents] == [("ab12", "ab12", "running"), ("cd34", "cd34", "running")] and [tuple(x) for x in a.agent_counts] == [("running", 2)]
    assert (s["s2"].status, s["s2"].stage) == ("waiting", "session")
    first = [("agent", "found ab12"), ("agent", "found cd34"), ("prompt", "go on"), ("stage", "spec-plan"), ("write", "Edit x.ts")]
    assert kinds(spark, out) == first
    # nothing new: the same version, no event again
    assert sessions.advance(spark, src, out, inventory) == 0 and kinds(spark, out) == first
    # a label and a workflow appear, one file is half-written; no transcript grows
    add(f"{sub}/agent-ab12.meta.json", {"description": "the reader", "agentType": "worker"})
    add(f"{src}/p/s1/workflows/wf_1.json", {"workflowName": "build", "workflowProgress": [{"type": "workflow_agent", "agentId": "cd34", "label": "late", "state": "failed"}]})
    add(f"{src}/p/s1/workflows/wf_2.json", '{"workflowName": "half')
    assert sessions.advance(spark, src, out, inventory) == 1
    s = state(spark, out)
    assert [(x.agent_id, x.desc, x.type, x.status, x.stage) for x in s["s1"].agents] == [("ab12", "the reader", "worker", "running", "session"), ("cd34", "late", None, "failed", "wf:build")]
    assert s["s2"].version == 0 and s["s1"].version == 1
    # the label changes, the agent ends, the main stream goes on with a broken line
    add(f"{sub}/agent-ab12.meta.json", {"description": "renamed"}, mode="w")
    os.utime(f"{sub}/agent-ab12.meta.json", (2e9, 2e9))
    add(f"{src}/p/s1/workflows/wf_1.json", "{half", mode="w")
    os.utime(f"{src}/p/s1/workflows/wf_1.json", (2e9, 2e9))
    add(f"{sub}/agent-ab12.jsonl", say(8, "b2", [{"type": "text", "text": "ok"}], stop_reason="end_turn"))
    add(main, "{broken", {"type": "system", "subtype": "turn_duration", "timestamp": "2026-02-01T00:00:09Z"})
    assert sessions.advance(spark, src, out, inventory) == 2
    a = state(spark, out)["s1"]
    assert (a.status, a.bad_lines, a.started_at, a.ended_at) == ("waiting", 1, "2026-02-01T00:00:01Z", "2026-02-01T00:00:09Z")
    assert [(x.desc, x.status) for x in a.agents] == [("late", "failed"), ("renamed", "completed")]
    assert kinds(spark, out) == sorted([*first, ("agent", "completed ab12"), ("error", "a line is no record")])
    assert [e.kind for e in a.events][-2:] in (["agent", "error"], ["error", "agent"])


def test_agents_that_end_in_other_ways(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sub = f"{src}/p/s/subagents"
    text = lambda t: [{"type": "text", "text": t}]
    add(f"{sub}/agent-old.jsonl", say(1, "a", [use("Read", "r")]), say(2, "b", text("all done")))
    add(f"{sub}/agent-int.jsonl", {"type": "user", "message": {"content": "[Request interrupted by user]"}})
    add(f"{sub}/agent-api.jsonl", say(1, "a", text("API Error: Connection lost")))
    add(f"{sub}/agent-run.jsonl", say(1, "a", text("done?"), stop_reason="end_turn"), {"type": "user", "message": {"content": "more"}})
    sessions.advance(spark, src, out)
    a = state(spark, out)["s"]
    assert {x.agent_id: x.status for x in a.agents} == {"old": "completed", "int": "interrupted", "api": "failed", "run": "running"}
    assert a.agents[0].agent_id == "run" and a.status == "running"
    assert ("agent", "completed old") not in kinds(spark, out) and ("error", "agent failed") in kinds(spark, out)


def test_a_replaced_transcript_takes_back_what_it_showed(spark, inventory, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    one, two = f"{src}/p/s.jsonl", f"{src}/p/s/subagents/agent-a.jsonl"
    read = lambda tid, start, n: [say(1, tid, [use("Read", tid, file_path="/w/A.kt")]), result(2, tid, {"file": {"startLine": start, "numLines": n}})]
    add(one, *read("x", 1, 6), *read("y", 3, 2))
    add(two, *read("z", 5, 4))
    sessions.advance(spark, src, out, inventory)
    assert state(spark, out)["s"].covered_lines == 8
    add(one, *read("n", 2, 1), mode="w")
    sessions.advance(spark, src, out, inventory)
    a = state(spark, out)["s"]
    assert (a.covered_lines, a.records, a.tool_calls, a.output_tokens, a.generation) == (5, 4, 2, 20, 1)
    assert kinds(spark, out).count(("reset", "transcript was replaced")) == 1


def test_texts_that_say_lines_and_stages():
    assert sessions.shown_spans({"file": {"numLines": 3}}, "x") == [[1, 3]]
    assert sessions.shown_spans(None, "  7\tseven\nno number\t\n         9\tfar\n12\t") == [[7, 1], [12, 1]]
    assert sessions.shown_spans(None, "a\nb") == [[1, 2]] and sessions.shown_spans(None, "") == []
    assert sessions._workflow('run({ name : "build it", x: 1 })') == "wf:build it"
    assert sessions._workflow("no 'name' here") == "" and sessions._workflow("") == ""
    assert sessions.merged([[5, 7], [1, 3], [3, 4], [9, 9]]) == [[1, 4], [5, 7], [9, 9]]


def test_coverage_equals_the_batch(spark, inventory, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    reads = [("s1", "/w/A.kt", 1, 4), ("s1", "/w/A.kt", 3, 5), ("s1", "/w/l.xml", 4, 9), ("s1", "/w/none.kt", 1, 3), ("s2", "/w/A.kt", 10, 9), ("s2", "/w/A.kt", 20, 2)]
    for k, (s, p, a, n) in enumerate(reads):
        add(f"{src}/p/{s}.jsonl", say(k, f"m{k}", [use("Read", f"t{k}", file_path=p)]), result(k, f"t{k}", {"file": {"startLine": a, "numLines": n}}))
        if k == 2:
            sessions.advance(spark, src, out, inventory)
    sessions.advance(spark, src, out, inventory)
    got = {r.session_id: (r.covered_files, r.covered_lines) for r in sessions.snapshot(spark, out).collect()}
    spans = spark.createDataFrame(reads, "session_id string, path string, start_line long, n long")
    want = {r.session_id: (r.files, r.lines) for r in lineage.coverage(spans, inventory, ["session_id"]).collect()}
    assert got == want == {"s1": (2, 9), "s2": (1, 1)}


def test_metadata_of_many_transcripts_is_not_listed_by_the_driver(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(300):
        add(f"{src}/p/s{k}/subagents/agent-a{k}.jsonl", prompt(1, "go"))
    add(f"{src}/p/s7/subagents/agent-a7.meta.json", {"description": "the seventh"})
    add(f"{src}/p/s7/workflows/wf_1.json", {"workflowName": "build", "workflowProgress": [{"type": "workflow_agent", "agentId": "a8", "label": "late"}]})
    add(f"{src}/p/s7/workflows/other.json", {"workflowName": "none of these"})
    seen = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    before = seen.getCount()
    got = {(r.session_id, r.agent_id, r.desc) for r in sessions.metadata(spark, src, out).collect()}
    assert got == {("s7", "a7", "the seventh"), ("s7", "a8", "late")} and seen.getCount() - before < 150


def test_an_inventory_is_not_broadcast(spark, inventory, tmp_path):
    add(f"{tmp_path}/in/p/s1.jsonl", prompt(1, "go"))
    landing.poll(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    inventory.write.parquet(f"{tmp_path}/inventory")
    stream = sessions.reduce(landing.lines(spark, f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/inventory"))
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(stream._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
