"""The nested trace document holds what the tables say."""

import json
from collections import defaultdict

from tracelake.plans import catalog

DATA = "/root/testdata/sf0.001"


def by_session(spark, name, *cols):
    out = defaultdict(list)
    for r in catalog.QUERIES[name](spark, DATA).collect():
        out[r.session_id].append(tuple(r[c] for c in cols))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_trace_document_holds_the_tables(spark):
    traces = {r.session_id: json.loads(r.trace) for r in catalog.QUERIES["trace_document"](spark, DATA).collect()}
    stages = by_session(spark, "time_accounts", "seg_no", "stage", "duration_ms", "active_ms", "wait_ms")
    tools = by_session(spark, "tool_pairs", "tool_id", "ok", "dur_ms")
    totals = {r.session_id: r for r in catalog.QUERIES["digest"](spark, DATA).collect()}
    assert set(traces) == set(stages) == set(totals)
    for k, t in traces.items():
        assert sorted((tuple(s[c] for c in ("seg_no", "stage", "duration_ms", "active_ms", "wait_ms")) for s in t["stages"]), key=str) == stages[k]
        assert sorted(((s["tool_id"], s.get("ok"), s.get("dur_ms")) for s in t.get("tools") or []), key=str) == tools.get(k, [])
        assert [s["seg_no"] for s in t["stages"]] == sorted(s["seg_no"] for s in t["stages"])
        assert (t["totals"]["calls"], t["totals"]["out_total"], t["totals"]["ctx_peak"]) == (totals[k].calls, totals[k].out_total, totals[k].ctx_peak)
        assert max(p["ctx"] for p in t["context_timeline"]) == t["totals"]["ctx_peak"]
