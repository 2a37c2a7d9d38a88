"""Operators against plain loops, on random and on edge inputs."""

import random

from pyspark.sql import functions as F

from tracelake.functions import paths, records
from tracelake.operators import blocks, documents, intervals, lineage, pairs, replay, segments, usage


def rnd_spans(r, n, keys=3, top=40):
    return [(r.randrange(keys), a, a + r.randrange(-1, 9)) for a in (r.randrange(top) for _ in range(n))]


def covered(spans, k):
    return {x for key, a, b in spans for x in range(a, b) if key == k}


def test_union_and_subtract_cover_the_same_points(spark):
    r = random.Random(1)
    for n in (0, 1, 30):
        rows, busy = rnd_spans(r, n), rnd_spans(r, n // 2)
        df, bz = spark.createDataFrame(rows, "k int, a long, b long"), spark.createDataFrame(busy, "k int, a long, b long")
        got = [tuple(x) for x in intervals.union(df, ["k"], "a", "b").collect()]
        left = [tuple(x) for x in intervals.subtract(df, bz, ["k"], "a", "b").select("k", "a", "b").collect()]
        for k in range(3):
            assert covered(got, k) == covered(rows, k)
            assert covered(left, k) == covered(rows, k) - covered(busy, k)
            mine = sorted(x for x in got if x[0] == k)
            assert all(x[2] < y[1] for x, y in zip(mine, mine[1:], strict=False))


def test_line_spans_of_the_incremental_union_case(spark):
    df = spark.createDataFrame([("p", 1, 2), ("p", 2, 2), ("p", 1, 3), ("p", 9, 0), ("p", 5, -1)], "path string, start_line long, n long")
    assert [tuple(x) for x in intervals.line_spans(df, ["path"]).collect()] == [("p", 1, 3)]


def test_replay_equals_a_fold(spark):
    r = random.Random(2)
    rows = [(f, i, r.choice(["set", "delta", "delta"]), r.randrange(-9, 9)) for f in range(12) for i in range(40)]
    rows = [(f, i, k, abs(v) if k == "set" else v) for f, i, k, v in rows]
    got = {(x.f, x.i): x.lines for x in replay.replay(spark.createDataFrame(rows, "f int, i int, kind string, val long"), ["f"], ["i"]).collect()}
    now = {}
    for f, i, k, v in rows:
        now[f] = v if k == "set" else max(0, now.get(f, 0) + v)
        assert got[f, i] == now[f]


def test_segments_number_repeats_and_name_single_stages(spark):
    marks = {1: [None, "verify", None, "execute", "execute", "verify"], 2: [None, None], 3: ["plan", "plan"]}
    rows = [(s, i, 100 - i, m) for s, x in marks.items() for i, m in enumerate(x)]
    got = [tuple(x)[:6] for x in segments.segments(spark.createDataFrame(rows, "session_id int, idx long, t_ms long, skill string")).orderBy("session_id", "seg_no").collect()]
    assert got == [(1, 0, "setup", "setup", 0, 0), (1, 1, "verify", "verify", 1, 2), (1, 2, "execute", "execute", 3, 4), (1, 3, "verify", "verify ·2", 5, 5), (2, 0, "session", "session", 0, 1), (3, 0, "session", "session", 0, 1)]


def test_asof_and_containing(spark):
    segs = spark.createDataFrame([(1, 0, "a", 5, 10, 20), (1, 1, "b", 8, 18, 30)], "session_id int, seg_no long, stage string, start_idx long, start_ms long, end_ms long")
    rows = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (1, 9, None), (2, 1, "z")], "session_id int, idx long, v string")
    got = {(x.session_id, x.idx): (x.v, x.seg_no) for x in segments.asof(rows, segs).collect()}
    assert got == {(1, 2): ("x", 0), (1, 5): ("y", 0), (1, 9): (None, 1), (2, 1): ("z", None)}
    at = spark.createDataFrame([(1, 19), (1, 40), (1, 1)], "session_id int, at_ms long")
    assert {x.at_ms: x.seg_no for x in segments.containing(at, segs).collect()} == {19: 0, 40: None, 1: None}
    assert {x.at_ms: x.seg_no for x in segments.containing(at, segs, fallback=True).collect()} == {19: 0, 40: 1, 1: 0}


def test_stalls_before_a_user_automatic_and_tail(spark):
    rows = [(1, 0, 0, "user"), (1, 1, 10, "close"), (1, 2, 12, "close"), (1, 3, 50, "user"), (1, 4, 60, "close"), (1, 5, 70, "other"), (1, 6, 80, "assistant"), (1, 7, 90, "close"), (1, 8, 99, "other")]
    got = sorted((x.a_ms, x.b_ms, x.kind, x.idx) for x in segments.stalls(spark.createDataFrame(rows, "session_id int, idx long, t_ms long, role string")).collect())
    assert got == [(10, 50, "user", 3), (60, 80, "auto", 6), (90, 99, "tail", None)]


def test_streamed_usage_settles_on_the_last_record(spark):
    rows = [(1, i, i, "m", model, 1, 0, 0, 0, out, 1, 1, 1) for i, (model, out) in enumerate([("a", 7), ("a", 84), ("a", 512), ("a", 1362)])] + [(1, 9, 9, "n", "<synthetic>", 1, 0, 0, 0, 5, 0, 0, 0)]
    df = spark.createDataFrame(rows, "session_id int, idx long, t_ms long, msg_id string, model string, inp long, cread long, cw5 long, cw1h long, out_tok long, ch_think long, ch_text long, ch_tool long")
    got = usage.settle(df).collect()
    assert [(x.idx, x.out_tok, x.ch_text) for x in got] == [(0, 1362, 4)]


def test_counters_with_a_reset(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 5, 9, 2, 3])], "session_id int, idx long, total long")
    assert [x.delta for x in usage.deltas(df).orderBy("idx").collect()] == [5, 4, 2, 1]


def test_last_and_first_result_win(spark):
    calls = spark.createDataFrame([(1, "t", 0, 0), (1, "u", 1, 1)], "session_id int, tool_id string, idx long, t_ms long")
    res = spark.createDataFrame([(1, "t", 2, 5, True), (1, "t", 3, 9, False)], "session_id int, tool_id string, idx long, t_ms long, ok boolean")
    last = {x.tool_id: (x.ok, x.dur_ms) for x in pairs.pair(calls, res).collect()}
    first = {x.tool_id: (x.ok, x.dur_ms) for x in pairs.pair(calls, res, last=False).collect()}
    assert last == {"t": (False, 9), "u": (None, None)} and first == {"t": (True, 5), "u": (None, None)}


JAVA = ["class Sample {", "    int alpha = 1;", "    int beta = 2;", "}"]


def test_visible_lines_cases(spark):
    src = spark.createDataFrame([(1, i, x) for i, x in enumerate(JAVA)], "doc_id int, line_no long, text string")
    out = lambda *x: spark.createDataFrame([(7, i, t) for i, t in enumerate(x)], "item_id int, line_no long, text string")
    assert [tuple(x) for x in documents.visible_unique(out(JAVA[2]), src).collect()] == [(7, 1, 2, 1)]
    assert [tuple(x) for x in blocks.matching_blocks(out("noise here", *JAVA[1:3]), src).collect()] == [(7, 1, 1, 2)]
    assert documents.visible_unique(out("Sample.java"), src).count() == blocks.matching_blocks(out(""), src).count() == 0
    shown = spark.createDataFrame([(1, 1, "int alpha = 1;"), (1, 2, "int gamma = 3;")], "doc_id int, line_no long, text string")
    assert [tuple(x) for x in documents.visible_numbered(shown, src).collect()] == [(1, 1)]


def test_blank_lines_inside_a_block(spark):
    text = ["first long line", "", "second long line", "third long line"]
    src = spark.createDataFrame([(1, i, x) for i, x in enumerate(["x", *text, "y"])], "doc_id int, line_no long, text string")
    out = spark.createDataFrame([(7, i, x) for i, x in enumerate(text)], "item_id int, line_no long, text string")
    assert [tuple(x) for x in blocks.matching_blocks(out, src).collect()] == [(7, 1, 1, 4)]


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_path_expressions(spark):
    kinds = {".migration/analysis/09-parser.md": "analysis", ".migration/architecture.md": "shared", "README.md": None, "spec/a/UI/page_x.md": "page", "spec/x_HANDOFF.md": "handoff", "spec/zzz": "other"}
    assert {k: one(spark, paths.document_kind(F.lit(k))) for k in kinds} == kinds
    assert one(spark, paths.output_kind(F.lit("Index.ETS"))) == "ets" and one(spark, paths.output_kind(F.lit("spec/a.ets"))) is None
    assert one(spark, paths.relative(F.lit("C:\\W\\p\\a.kt"), F.lit("c:/w/p/"))) == "a.kt"
    assert one(spark, paths.relative(F.lit("/z/Spec/b.md"), F.lit("/w"))) == "Spec/b.md"
    assert one(spark, paths.drive(F.lit("'/d/x/y'"))) == "D:/x/y"
    text = "cat \"a/B.kt\" 'c d/e.java' a/b.KT ; grep x ./f/g.xml C:\\h\\i.yml"
    assert one(spark, paths.literals(F.lit(text))) == ["a/B.kt", "c d/e.java", "d/e.java", "./f/g.xml", "C:\\h\\i.yml"]
    assert one(spark, paths.command_bases(F.lit("cd /c/x && pushd 'y z'; Set-Location -Path \"w\""), F.lit("/b"))) == ["/b", "C:/x", "y z", "w"]


def test_record_expressions(spark):
    assert one(spark, records.tool_brief(F.lit('{"path":" ","command":"a\\n  b"}'))) == "a b"
    end = lambda kind, text, stop: one(spark, records.abort_reason(F.lit(kind), F.lit(text), F.lit(stop).cast("string")))
    assert [end("assistant", "ok", "end_turn"), end("user", "x", None), end("assistant", "API Error: connection", None), end("assistant", "API error", "tool_use"), end("assistant", "Request interrupted", "end_turn")] == [None, "interrupted", "api_error", "api_error", "interrupted"]
    failed = lambda t: one(spark, records.tool_failed(F.lit(t)))
    assert [failed("Exit code: 0"), failed("exit code: -1"), failed('{"isError": true}'), failed("Script failed"), failed(None)] == [False, True, True, True, False]
    assert one(spark, records.query_terms(F.lit("Find foo_bar in 数据血缘 a b"))) == ["find", "foo_bar", "数据", "据血", "血缘"]
    assert one(spark, records.skill_mentions(F.lit("x/skills/a-b/SKILL.md \\\\skills\\\\c\\\\skill.md /skills/a-b/SKILL.md"))) == ["a-b", "c"]
    js = 'const p = "*** Begin Patch\\n*** Add File: a.ts\\n+x\\n+y\\n*** End Patch"; tools.apply_patch(p); tools.shell_command({command: "ls \\"q\\"", workdir: "/w"}); tools.shell_command({"command":"pwd"})'
    assert one(spark, records.patch_texts(F.lit(js)))[0].startswith("*** Begin Patch\n*** Add File: a.ts")
    assert [(x.command, x.workdir) for x in one(spark, records.shell_calls(F.lit(js), F.lit("/d")))] == [('ls "q"', "/w"), ("pwd", "/d")]


def test_patch_operations(spark):
    text = ["*** Begin Patch", "*** Add File: a.ts", "+x", "+y", "*** Update File: b.ts ", "@@", "-o", "+n", "+n2", "--- no", "+++ no", "*** Delete File: c.ts", "-gone"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "p int, line_no long, text string")
    got = [(x.action, x.path, x.added, x.removed, x.kind, x.val) for x in documents.patch_ops(df, ["p"]).orderBy("ord").collect()]
    assert got == [("Add", "a.ts", 2, 0, "set", 2), ("Update", "b.ts", 2, 1, "delta", 1), ("Delete", "c.ts", 0, 1, "delta", -1)]


def test_coverage_is_clipped_and_in_scope(spark):
    reads = spark.createDataFrame([(1, "A", 8, 10), (1, "a", 1, 2), (1, "zz", 1, 5)], "s int, path string, start_line long, n long")
    inv = spark.createDataFrame([("a", 10, True), ("b", 5, False)], "path string, n_lines long, is_code boolean")
    got = lineage.coverage(reads, inv, ["s"]).first()
    assert (got.files, got.lines, got.total_files, got.total_lines) == (1, 5, 2, 15)


def test_retrieval_falls_back_to_recent_records(spark):
    df = spark.createDataFrame([(1, i, "alpha beta" if i == 3 else "x") for i in range(40)], "conv_id int, turn int, text string")
    assert [(x.turn, x.score) for x in documents.retrieve(df, "alpha").collect()] == [(3, 1)]
    assert documents.retrieve(df, "nothing here").count() == 24


def test_conversation_bounds(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "t" * 3) for i in range(25)] + [(2, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 0, "user", "z" * 20000), (4, 0, "system", "s")]
    got = {x.conv_id: (x.kept, x.chars, x.valid) for x in documents.bound_conversation(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {1: (20, 60, True), 2: (2, 2, False), 3: (1, 12000, True), 4: (0, 0, False)}


def test_get_content_paths(spark):
    c = "$a = 'x/A.kt'; Get-Content -Path $a | head; Get-Content \"y/B.kt\"; Get-Content $b; Get-Content 'z*.kt'; Get-Content 'x/A.kt'"
    assert one(spark, records.content_paths(F.lit(c))) == ["x/A.kt", "y/B.kt"]
