"""Queries of segments, pairing, usage, time and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import records
from tracelake.operators import agents, intervals, pairs, replay, segments, usage
from tracelake.plans.views import DERIVED, frame, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            ORACLE_SQL[name] = sql(text)
        return f

    return add


DERIVED |= {
    "d_mark": """SELECT session_id, idx, t_ms, skill, max(CASE WHEN skill IS NOT NULL THEN idx END) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v_stage_mark""",
    "d_bound": """SELECT m.session_id, m.idx, m.skill AS stage FROM d_mark m LEFT JOIN d_mark b ON b.session_id = m.session_id AND b.idx = m.p WHERE m.skill IS NOT NULL AND (m.p IS NULL OR m.skill <> b.skill)""",
    "d_bounds": """SELECT session_id, idx, stage FROM d_bound UNION ALL
        SELECT session_id, 0, 'setup' FROM v_rec WHERE idx = 0 AND NOT EXISTS (SELECT 1 FROM d_bound b WHERE b.session_id = v_rec.session_id AND b.idx = 0)""",
    "d_raw": """SELECT session_id, row_number() OVER w - 1 AS seg_no, stage, idx AS start_idx, coalesce(lead(idx) OVER w - 1, (SELECT max(r.idx) FROM v_rec r WHERE r.session_id = d_bounds.session_id)) AS end_idx,
        count(*) OVER (PARTITION BY session_id) AS k FROM d_bounds WINDOW w AS (PARTITION BY session_id ORDER BY idx)""",
    "d_seg": """SELECT s.session_id, s.seg_no, CASE WHEN s.k = 1 THEN 'session' ELSE stage END AS stage, start_idx, end_idx, min(t_ms) AS start_ms, max(t_ms) AS end_ms
        FROM d_raw s JOIN v_rec r ON r.session_id = s.session_id AND r.idx BETWEEN start_idx AND end_idx GROUP BY s.session_id, s.seg_no, 3, start_idx, end_idx""",
    "d_settled": """SELECT session_id, msg_id, min(idx) AS idx, arg_min(t_ms, idx) AS t_ms, arg_min(model, idx) AS model, arg_max(inp, idx) AS inp, arg_max(cread, idx) AS cread, arg_max(cw5, idx) AS cw5,
        arg_max(cw1h, idx) AS cw1h, arg_max(out_tok, idx) AS out_tok, CAST(sum(ch_think) AS BIGINT) AS ch_think, CAST(sum(ch_text) AS BIGINT) AS ch_text, CAST(sum(ch_tool) AS BIGINT) AS ch_tool FROM v_usage GROUP BY session_id, msg_id""",
    "d_bill": """SELECT session_id, model, count(*) AS req, CAST(sum(inp) AS BIGINT) AS inp, CAST(sum(cread) AS BIGINT) AS cread, CAST(sum(cw5) AS BIGINT) AS cw5, CAST(sum(cw1h) AS BIGINT) AS cw1h, CAST(sum(out_tok) AS BIGINT) AS out_tok FROM d_settled GROUP BY ALL""",
    "d_cost": """SELECT *, inp * CASE model WHEN 'm1' THEN 2.0 ELSE 5.0 END / 1e6 AS usd_in, cread * CASE model WHEN 'm1' THEN 2.0 ELSE 5.0 END * 0.1 / 1e6 AS usd_read,
        (cw5 * 1.25 + cw1h * 2.0) * CASE model WHEN 'm1' THEN 2.0 ELSE 5.0 END / 1e6 AS usd_write, out_tok * CASE model WHEN 'm1' THEN 10.0 ELSE 25.0 END / 1e6 AS usd_out FROM d_bill""",
    "d_act": "SELECT session_id, idx, t_ms, role, sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM v_turn",
    "d_stalls": """SELECT c.session_id, c.a_ms, coalesce(r.t_ms, (SELECT arg_max(t_ms, idx) FROM v_turn t WHERE t.session_id = c.session_id)) AS b_ms,
        CASE WHEN r.role IS NULL THEN 'tail' WHEN r.role = 'user' THEN 'user' ELSE 'auto' END AS kind, r.idx
        FROM (SELECT session_id, g, arg_min(t_ms, idx) AS a_ms FROM d_act WHERE role = 'close' GROUP BY session_id, g) c
        LEFT JOIN (SELECT * FROM d_act WHERE role IN ('user', 'assistant')) r ON r.session_id = c.session_id AND r.g = c.g + 1""",
    "d_busy_run": """SELECT session_id, a_ms, b_ms, sum(n) OVER (PARTITION BY session_id ORDER BY a_ms, b_ms ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT session_id, a_ms, b_ms,
        CASE WHEN a_ms <= max(b_ms) OVER (PARTITION BY session_id ORDER BY a_ms, b_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM v_busy)""",
    "d_busy": "SELECT session_id, min(a_ms) AS a_ms, max(b_ms) AS b_ms FROM d_busy_run GROUP BY session_id, run",
    "d_free": """SELECT session_id, b_ms AS fa, coalesce(lead(a_ms) OVER (PARTITION BY session_id ORDER BY a_ms), 9000000000000000) AS fb FROM d_busy UNION ALL SELECT session_id, 0, min(a_ms) FROM d_busy GROUP BY session_id
        UNION ALL SELECT DISTINCT session_id, 0, 9000000000000000 FROM v_rec WHERE session_id NOT IN (SELECT session_id FROM v_busy)""",
    "d_all_stalls": "SELECT session_id, a_ms, b_ms, kind, idx FROM d_stalls UNION ALL SELECT session_id, t_ms, t_ms + dur_ms, 'user', NULL FROM d_pair WHERE name = 'tool4' AND dur_ms > 0",
    "d_all_busy": """WITH b AS (SELECT session_id, t_ms AS a_ms, t_ms + dur_ms AS b_ms FROM d_pair WHERE name <> 'tool4' AND dur_ms > 0 UNION ALL SELECT session_id, a_ms, b_ms FROM v_busy WHERE b_ms > a_ms),
        r AS (SELECT session_id, a_ms, b_ms, sum(n) OVER (PARTITION BY session_id ORDER BY a_ms, b_ms ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN a_ms <= max(b_ms) OVER (PARTITION BY session_id ORDER BY a_ms, b_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM b))
        SELECT session_id, min(a_ms) AS a_ms, max(b_ms) AS b_ms FROM r GROUP BY session_id, run""",
    "d_all_free": """SELECT session_id, b_ms AS fa, coalesce(lead(a_ms) OVER (PARTITION BY session_id ORDER BY a_ms), 9000000000000000) AS fb FROM d_all_busy UNION ALL SELECT session_id, 0, min(a_ms) FROM d_all_busy GROUP BY session_id
        UNION ALL SELECT DISTINCT session_id, 0, 9000000000000000 FROM v_rec WHERE session_id NOT IN (SELECT session_id FROM d_all_busy)""",
    "d_pieces": """SELECT s.session_id, greatest(a_ms, fa) AS a_ms, least(b_ms, fb) AS b_ms, kind, idx FROM d_all_stalls s JOIN d_all_free f ON f.session_id = s.session_id WHERE least(b_ms, fb) > greatest(a_ms, fa)""",
    "d_pair": """SELECT c.session_id, c.tool_id, c.idx, c.t_ms, c.name, r.ok, CASE WHEN r.t_ms IS NOT NULL THEN greatest(0, r.t_ms - c.t_ms) END AS dur_ms FROM v_call c LEFT JOIN
        (SELECT session_id, tool_id, arg_max(ok, idx) AS ok, arg_max(t_ms, idx) AS t_ms FROM v_result GROUP BY ALL) r ON r.session_id = c.session_id AND r.tool_id = c.tool_id""",
    "d_edge": """SELECT session_id % 10 AS lineage, session_id, path, idx, t_ms, kind, val FROM v_write""",
}


def seg(spark, d) -> DataFrame:
    return segments.segments(frame(spark, d, "v_stage_mark"))


@query("record_index", "SELECT session_id, count(*) AS n, min(idx) AS min_idx, max(idx) AS max_idx, count(DISTINCT idx) AS n_idx FROM v_rec GROUP BY session_id")
def record_index(spark, d):
    return frame(spark, d, "v_rec").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"), F.count_distinct("idx").alias("n_idx"))


@query("fork_trim", "SELECT r.session_id, r.idx FROM v_rec r LEFT JOIN (SELECT session_id, max(idx) AS f FROM v_rec WHERE event_type = 'signup' GROUP BY session_id) m ON m.session_id = r.session_id WHERE r.idx >= coalesce(m.f, 0)")
def fork_trim(spark, d):
    from tracelake.sources.transcripts import trim_to_fork

    return trim_to_fork(frame(spark, d, "v_rec"), F.col("event_type") == "signup", "session_id").select("session_id", "idx")


@query("session_lookup", """WITH s AS (SELECT CAST(session_id AS VARCHAR) AS id, 'Proj-' || (session_id % 7) AS project, max(t_ms) AS mtime FROM v_rec GROUP BY session_id), p AS (SELECT unnest(['1', '14', '149', 'PROJ-3', 'oj-', 'none']) AS target),
    h AS (SELECT target, id, project, mtime, starts_with(id, target) AS own, contains(lower(project), lower(target)) AS low FROM p, s)
    SELECT target, count_if(own) AS matches, count_if(own) = 1 AS is_unique, count(DISTINCT CASE WHEN low THEN project END) AS projects, CASE WHEN count_if(own) = 1 THEN max(CASE WHEN own THEN id END) WHEN count_if(own) = 0 THEN arg_max(id, (mtime, id)) FILTER (WHERE low) END AS chosen FROM h GROUP BY target""")
def session_lookup(spark, d):
    from tracelake.sources.transcripts import lookup

    sid = F.col("session_id")
    sessions = frame(spark, d, "v_rec").groupBy(sid).agg(F.max("t_ms").alias("mtime")).select(sid.cast("string").alias("id"), F.concat(F.lit("Proj-"), (sid % 7).cast("string")).alias("project"), "mtime")
    return lookup(sessions, ["1", "14", "149", "PROJ-3", "oj-", "none"])


@query("recent_sessions", "SELECT session_id, max(t_ms) AS last_ms FROM v_rec GROUP BY session_id ORDER BY last_ms DESC, session_id LIMIT 20")
def recent_sessions(spark, d):
    last = frame(spark, d, "v_rec").groupBy("session_id").agg(F.max("t_ms").alias("last_ms"))
    return last.orderBy(F.desc("last_ms"), "session_id").limit(20)


@query("ms_between", "SELECT session_id, idx, t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY idx) AS gap_ms FROM v_rec")
def ms_between(spark, d):
    return frame(spark, d, "v_rec").select("session_id", "idx", (F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("session_id").orderBy("idx"))).alias("gap_ms"))


@query("stage_segments", """SELECT session_id, seg_no, stage, CASE WHEN n > 1 THEN stage || ' ·' || n ELSE stage END AS label, start_idx, end_idx, start_ms, end_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, stage ORDER BY seg_no) AS n FROM d_seg)""")
def stage_segments(spark, d):
    return seg(spark, d)


@query("stage_segments_calls", """WITH c AS (SELECT session_id, idx, name, lag(name) OVER (PARTITION BY session_id ORDER BY idx) AS p FROM v_call),
    b AS (SELECT session_id, idx, name AS stage, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS seg_no FROM c WHERE p IS NULL OR p <> name)
    SELECT session_id, seg_no, stage, idx AS start_idx, lead(idx) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS end_idx FROM b""")
def stage_segments_calls(spark, d):
    runs = segments.assign(frame(spark, d, "v_call"), skill="name").groupBy("session_id", "seg_no").agg(F.first("stage").alias("stage"), F.min("idx").alias("start_idx"))
    w = Window.partitionBy("session_id").orderBy("seg_no")
    return runs.withColumn("end_idx", F.lead("start_idx").over(w) - 1)


DERIVED["d_bounds_all"] = """SELECT session_id, idx, min(stage) AS stage FROM (SELECT session_id, idx, stage FROM d_bound
    UNION ALL SELECT session_id, min(idx), name FROM v_call WHERE name IN ('tool1', 'tool2') GROUP BY session_id, name
    UNION ALL SELECT session_id, idx, 'wf:w' || (k % 3) FROM v_rec WHERE event_type IN ('purchase', 'view') AND k % 20 = 0) GROUP BY session_id, idx"""


@query("stage_boundaries", "SELECT session_id, idx, stage FROM d_bounds_all")
def stage_boundaries(spark, d):
    calls = frame(spark, d, "v_call").filter("name in ('tool1', 'tool2')").withColumnRenamed("name", "skill")
    runs = frame(spark, d, "v_rec").filter("event_type in ('purchase', 'view') and k % 20 = 0").select("session_id", "idx", F.concat(F.lit("w"), (F.col("k") % 3).cast("string")).alias("name"))
    return segments.boundaries(frame(spark, d, "v_stage_mark"), calls, runs)


@query("stage_assembly", """WITH b AS (SELECT * FROM d_bounds_all UNION ALL SELECT session_id, 0, 'setup' FROM v_rec WHERE idx = 0 AND session_id NOT IN (SELECT session_id FROM d_bounds_all WHERE idx = 0)),
    s AS (SELECT session_id, row_number() OVER w - 1 AS seg_no, stage, idx AS a, coalesce(lead(idx) OVER w, 1000000000) AS z, count(*) OVER (PARTITION BY session_id) AS k FROM b WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
    t AS (SELECT s.session_id, seg_no, CASE WHEN s.k = 1 THEN 'session' ELSE stage END AS stage, min(r.idx) AS start_idx, max(r.idx) AS end_idx, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM s JOIN v_rec r ON r.session_id = s.session_id AND r.idx >= a AND r.idx < z GROUP BY ALL)
    SELECT session_id, seg_no, stage, CASE WHEN n > 1 THEN stage || ' ·' || n ELSE stage END AS label, start_idx, end_idx, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, stage ORDER BY seg_no) AS n FROM t)""")
def stage_assembly(spark, d):
    """Stages opened by attribution, by calls of skills that are never attributed, and by workflows."""
    return segments.segments_at(frame(spark, d, "v_rec"), stage_boundaries(spark, d))


@query("workflow_launches", """WITH c AS (SELECT session_id, idx, CASE WHEN k % 3 = 0 THEN 'T' || (k % 4) END AS task FROM v_rec WHERE event_type = 'purchase'), r AS (SELECT DISTINCT session_id, k % 4 AS t FROM v_rec WHERE event_type = 'signup'),
    n AS (SELECT c.session_id, c.idx, 'run' || r.t AS run_id FROM c JOIN r ON r.session_id = c.session_id AND c.task = 'T' || r.t), o AS (SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.session_id = c.session_id AND n.idx = c.idx)),
    s AS (SELECT session_id, 'run' || t AS run_id, row_number() OVER (PARTITION BY session_id ORDER BY t) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.session_id = r.session_id AND n.run_id = 'run' || r.t))
    SELECT session_id, idx, run_id, 'w' || substr(run_id, 4) AS name FROM (SELECT * FROM n UNION ALL SELECT o.session_id, o.idx, s.run_id FROM o JOIN s ON s.session_id = o.session_id AND s.n = o.n)""")
def workflow_launches(spark, d):
    r = frame(spark, d, "v_rec")
    calls = r.filter("event_type = 'purchase'").select("session_id", "idx", F.when(F.col("k") % 3 == 0, F.concat(F.lit("started. Task ID: T"), (F.col("k") % 4).cast("string"), F.lit(" now"))).otherwise("started").alias("result"))
    n = (F.col("k") % 4).cast("string")
    runs = r.filter("event_type = 'signup'").select("session_id", F.concat(F.lit("run"), n).alias("run_id"), F.concat(F.lit("T"), n).alias("task_id"), F.concat(F.lit("w"), n).alias("name")).distinct()
    return agents.launches(calls, runs)


@query("asof_stage", "SELECT r.session_id, r.idx, s.seg_no, s.stage FROM v_rec r JOIN d_seg s ON s.session_id = r.session_id AND r.idx BETWEEN s.start_idx AND s.end_idx")
def asof_stage(spark, d):
    return segments.asof(frame(spark, d, "v_rec").select("session_id", "idx"), seg(spark, d))


@query("tool_pairs", "SELECT session_id, tool_id, idx, name, ok, dur_ms FROM d_pair")
def tool_pairs(spark, d):
    return pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result")).select("session_id", "tool_id", "idx", "name", "ok", "dur_ms")


@query("tool_pairs_first", """SELECT c.session_id, c.tool_id, c.idx, c.name, r.ok, CASE WHEN r.t_ms IS NOT NULL THEN greatest(0, r.t_ms - c.t_ms) END AS dur_ms FROM v_call c LEFT JOIN
    (SELECT session_id, tool_id, arg_min(ok, idx) AS ok, arg_min(t_ms, idx) AS t_ms FROM v_result GROUP BY ALL) r ON r.session_id = c.session_id AND r.tool_id = c.tool_id""")
def tool_pairs_first(spark, d):
    return pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result"), last=False).select("session_id", "tool_id", "idx", "name", "ok", "dur_ms")


@query("agent_link", """SELECT r.session_id, r.idx, r.tool_id, s.seg_no, s.stage FROM v_result r LEFT JOIN v_call c ON c.session_id = r.session_id AND c.tool_id = r.tool_id
    LEFT JOIN d_seg s ON s.session_id = c.session_id AND c.idx BETWEEN s.start_idx AND s.end_idx""")
def agent_link(spark, d):
    calls = segments.asof(frame(spark, d, "v_call").select("session_id", "idx", "tool_id"), seg(spark, d)).drop("idx")
    return frame(spark, d, "v_result").join(calls, ["session_id", "tool_id"], "left").select("session_id", "idx", "tool_id", "seg_no", "stage")


_NEXT = "SELECT session_id - 1 AS session_id, min(t_ms) AS at_ms FROM v_rec GROUP BY session_id"


def _starts(spark, d) -> DataFrame:
    return frame(spark, d, "v_rec").groupBy("session_id").agg(F.min("t_ms").alias("at_ms")).select((F.col("session_id") - 1).alias("session_id"), "at_ms")


@query("agent_link_time", f"SELECT a.session_id, a.at_ms, min(s.seg_no) AS seg_no FROM ({_NEXT}) a LEFT JOIN d_seg s ON s.session_id = a.session_id AND a.at_ms BETWEEN s.start_ms AND s.end_ms GROUP BY ALL")
def agent_link_time(spark, d):
    return segments.containing(_starts(spark, d), seg(spark, d))


@query("interval_asof", f"""SELECT a.session_id, a.at_ms, coalesce((SELECT min(seg_no) FROM d_seg s WHERE s.session_id = a.session_id AND a.at_ms BETWEEN s.start_ms AND s.end_ms),
    (SELECT arg_max(seg_no, start_ms * 100000 + seg_no) FROM d_seg s WHERE s.session_id = a.session_id AND s.start_ms <= a.at_ms), (SELECT min(seg_no) FROM d_seg s WHERE s.session_id = a.session_id)) AS seg_no FROM ({_NEXT}) a""")
def interval_asof(spark, d):
    return segments.containing(_starts(spark, d), seg(spark, d), fallback=True)


@query("positional_match", """WITH l AS (SELECT session_id, tool_id AS call_id, row_number() OVER (PARTITION BY session_id ORDER BY tool_id) AS pos FROM v_call c WHERE NOT EXISTS (SELECT 1 FROM v_result r WHERE r.session_id = c.session_id AND r.tool_id = c.tool_id)),
    r AS (SELECT session_id, idx AS result_idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS pos FROM v_result r WHERE NOT EXISTS (SELECT 1 FROM v_call c WHERE r.session_id = c.session_id AND r.tool_id = c.tool_id))
    SELECT coalesce(l.session_id, r.session_id) AS session_id, coalesce(l.pos, r.pos) AS pos, call_id, result_idx FROM l FULL JOIN r ON l.session_id = r.session_id AND l.pos = r.pos""")
def positional_match(spark, d):
    calls, results = frame(spark, d, "v_call"), frame(spark, d, "v_result")
    on = ["session_id", "tool_id"]
    return pairs.by_place(calls.join(results, on, "left_anti").withColumnRenamed("tool_id", "call_id"), results.join(calls, on, "left_anti").withColumnRenamed("idx", "result_idx"), ["session_id"], "call_id", "result_idx")


@query("interval_union", """WITH s AS (SELECT session_id, path, start_line AS a, start_line + n - 1 AS b FROM v_read_span WHERE n > 0),
    m AS (SELECT *, CASE WHEN a <= 1 + max(b) OVER (PARTITION BY session_id, path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
    r AS (SELECT *, sum(n) OVER (PARTITION BY session_id, path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT session_id, path, min(a) AS start_line, max(b) AS end_line FROM r GROUP BY session_id, path, run""")
def interval_union(spark, d):
    return intervals.line_spans(frame(spark, d, "v_read_span"), ["session_id", "path"])


@query("stalls", "SELECT session_id, a_ms, b_ms, kind, idx FROM d_stalls")
def stalls(spark, d):
    return segments.stalls(frame(spark, d, "v_turn"))


def _tools(spark, d) -> DataFrame:
    return pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result"))


@query("question_windows", "SELECT session_id, a_ms, b_ms, kind, idx FROM d_all_stalls")
def question_windows(spark, d):
    """Closed turns, and the questions (here tool4) that wait for the user."""
    return segments.stalls(frame(spark, d, "v_turn")).unionByName(segments.question_stalls(_tools(spark, d), question="tool4"))


def _busy(spark, d) -> DataFrame:
    lives = frame(spark, d, "v_busy").select("session_id", F.col("a_ms").alias("start_ms"), F.col("b_ms").alias("end_ms"))
    return segments.busy(_tools(spark, d), lives, question="tool4")


@query("busy_windows", "SELECT session_id, a_ms, b_ms FROM d_all_busy")
def busy_windows(spark, d):
    """Merged time of tools but for questions, and of agents."""
    return intervals.union(_busy(spark, d), ["session_id"], "a_ms", "b_ms")


@query("busy_union", "SELECT session_id, a_ms, b_ms FROM d_busy")
def busy_union(spark, d):
    return intervals.union(frame(spark, d, "v_busy"), ["session_id"], "a_ms", "b_ms")


def pieces(spark, d) -> DataFrame:
    """Stalls of turns and questions, without the time in which tools or agents were at work."""
    return intervals.subtract(question_windows(spark, d), _busy(spark, d), ["session_id"], "a_ms", "b_ms")


@query("interval_subtract", "SELECT session_id, a_ms, b_ms, kind FROM d_pieces")
def interval_subtract(spark, d):
    return pieces(spark, d).select("session_id", "a_ms", "b_ms", "kind")


@query("prompt_wait", "SELECT session_id, idx, CAST(sum(b_ms - a_ms) AS BIGINT) AS wait_ms FROM d_pieces WHERE kind = 'user' AND idx IS NOT NULL GROUP BY ALL")
def prompt_wait(spark, d):
    return pieces(spark, d).filter("kind = 'user' and idx is not null").groupBy("session_id", "idx").agg(F.sum(F.col("b_ms") - F.col("a_ms")).alias("wait_ms"))


DERIVED["d_time"] = """SELECT s.session_id, s.seg_no, s.stage, s.end_ms - s.start_ms AS duration_ms,
    CAST(coalesce(sum(greatest(0, least(p.b_ms, s.end_ms) - greatest(p.a_ms, s.start_ms))) FILTER (WHERE p.a_ms IS NOT NULL), 0) AS BIGINT) AS st, CAST(coalesce(sum(CASE WHEN p.kind = 'user' THEN greatest(0, least(p.b_ms, s.end_ms) - greatest(p.a_ms, s.start_ms)) END), 0) AS BIGINT) AS wa
    FROM d_seg s LEFT JOIN d_pieces p ON p.session_id = s.session_id GROUP BY s.session_id, s.seg_no, s.stage, s.start_ms, s.end_ms"""


@query("time_accounts", "SELECT session_id, seg_no, stage, duration_ms, duration_ms - least(st, duration_ms) AS active_ms, least(wa, st, duration_ms) AS wait_ms FROM d_time")
def time_accounts(spark, d):
    return segments.time_accounts(pieces(spark, d), seg(spark, d))


@query("usage_settle", "SELECT * FROM d_settled")
def usage_settle(spark, d):
    return usage.settle(frame(spark, d, "v_usage"))


@query("billing", "SELECT * FROM d_bill")
def billing(spark, d):
    return usage.billing(usage.settle(frame(spark, d, "v_usage")))


@query("cost", "SELECT session_id, model, round(usd_in + usd_read + usd_write + usd_out, 9) AS usd FROM d_cost")
def cost(spark, d):
    rows = usage.priced(usage.billing(usage.settle(frame(spark, d, "v_usage"))))
    return rows.select("session_id", "model", F.round(F.col("usd_in") + F.col("usd_read") + F.col("usd_write") + F.col("usd_out"), 9).alias("usd"))


@query("cost_buckets", "SELECT session_id, round(sum(usd_read), 9) AS cread, round(sum(usd_write), 9) AS cw, round(sum(usd_in), 9) AS inp, round(sum(usd_out), 9) AS out FROM d_cost GROUP BY session_id")
def cost_buckets(spark, d):
    rows = usage.priced(usage.billing(usage.settle(frame(spark, d, "v_usage"))))
    return rows.groupBy("session_id").agg(*[F.round(F.sum(c), 9).alias(n) for n, c in (("cread", "usd_read"), ("cw", "usd_write"), ("inp", "usd_in"), ("out", "usd_out"))])


@query("output_split", """WITH s AS (SELECT session_id, out_tok, ch_think AS a, ch_text AS b, ch_tool AS c, ch_think + ch_text + ch_tool AS t FROM d_settled)
    SELECT session_id, CAST(round_even(sum(CASE WHEN t > 0 THEN out_tok * a / t ELSE 0 END), 0) AS BIGINT) AS out_thinking, CAST(round_even(sum(CASE WHEN t > 0 THEN out_tok * b / t ELSE out_tok END), 0) AS BIGINT) AS out_text,
    CAST(round_even(sum(CASE WHEN t > 0 THEN out_tok * c / t ELSE 0 END), 0) AS BIGINT) AS out_tool FROM s GROUP BY session_id""")
def output_split(spark, d):
    return usage.output_split(usage.settle(frame(spark, d, "v_usage")), ["session_id"])


@query("context_timeline", "SELECT session_id, idx, inp + cread + cw5 + cw1h AS ctx, max(inp + cread + cw5 + cw1h) OVER (PARTITION BY session_id) AS peak FROM d_settled")
def context_timeline(spark, d):
    return usage.context_timeline(usage.settle(frame(spark, d, "v_usage")))


@query("usage_deltas", """WITH l AS (SELECT session_id, idx, total, coalesce(lag(total) OVER (PARTITION BY session_id ORDER BY idx), 0) AS p FROM v_counter)
    SELECT session_id, idx, CASE WHEN total < p THEN total ELSE total - p END AS delta FROM l WHERE CASE WHEN total < p THEN total ELSE total - p END > 0""")
def usage_deltas(spark, d):
    return usage.deltas(frame(spark, d, "v_counter"))


@query("inherited_usage", """WITH f AS (SELECT session_id, min(idx) AS f FROM v_counter WHERE event_type = 'signup' GROUP BY session_id), b AS (SELECT c.session_id, arg_max(total, idx) AS base FROM v_counter c JOIN f USING (session_id) WHERE idx < f GROUP BY c.session_id)
    SELECT c.session_id, c.idx, greatest(0, c.total - coalesce(b.base, 0)) AS own_total FROM v_counter c JOIN f ON f.session_id = c.session_id AND c.idx >= f.f LEFT JOIN b ON b.session_id = c.session_id""")
def inherited_usage(spark, d):
    c = frame(spark, d, "v_counter")
    return usage.inherited(c, c.filter("event_type = 'signup'").groupBy("session_id").agg(F.min("idx").alias("fork_idx")))


_FOLD = """WITH RECURSIVE o AS (SELECT lineage, path, kind, val, t_ms, session_id, idx, row_number() OVER (PARTITION BY lineage, path ORDER BY t_ms, session_id, idx) AS n FROM v_write),
    x AS (SELECT lineage, path, n, t_ms, session_id, idx, CASE WHEN kind = 'set' THEN val ELSE greatest(0, val) END AS lines FROM o WHERE n = 1
    UNION ALL SELECT o.lineage, o.path, o.n, o.t_ms, o.session_id, o.idx, CASE WHEN o.kind = 'set' THEN o.val ELSE greatest(0, x.lines + o.val) END FROM x JOIN o ON o.lineage = x.lineage AND o.path = x.path AND o.n = x.n + 1)"""
_ORDER = ["t_ms", "session_id", "idx"]


@query("final_lines", f"{_FOLD} SELECT lineage, path, arg_max(lines, n) AS final_lines, count(*) AS n_events FROM x GROUP BY lineage, path")
def final_lines(spark, d):
    return replay.final_lines(frame(spark, d, "v_write"), ["lineage", "path"], _ORDER)


@query("code_timeline", f"""{_FOLD}, y AS (SELECT lineage, t_ms, session_id, idx, lines - coalesce(lag(lines) OVER (PARTITION BY lineage, path ORDER BY n), 0) AS dl FROM x),
    z AS (SELECT lineage, t_ms, row_number() OVER w - 1 AS pos, CAST(sum(dl) OVER w AS BIGINT) AS total, count(*) OVER (PARTITION BY lineage) AS n FROM y WINDOW w AS (PARTITION BY lineage ORDER BY t_ms, session_id, idx ROWS UNBOUNDED PRECEDING))
    SELECT lineage, pos, t_ms, total FROM z WHERE pos % CASE WHEN n > 1500 THEN n // 1500 + 1 ELSE 1 END = 0 OR pos = n - 1""")
def code_timeline(spark, d):
    return replay.timeline(frame(spark, d, "v_write"), ["lineage"], "path", _ORDER)


@query("session_meta", """SELECT session_id, arg_min(event_type, idx) AS first_type, arg_min(value, idx) FILTER (WHERE event_type = 'purchase') AS first_value, arg_min(t_ms, idx) AS started_ms, arg_max(t_ms, idx) AS ended_ms, count(*) AS n_records FROM v_rec GROUP BY session_id""")
def session_meta(spark, d):
    r = frame(spark, d, "v_rec").groupBy("session_id")
    return r.agg(F.min_by("event_type", "idx").alias("first_type"), F.min_by("value", F.when(F.col("event_type") == "purchase", F.col("idx"))).alias("first_value"), F.min_by("t_ms", "idx").alias("started_ms"), F.max_by("t_ms", "idx").alias("ended_ms"), F.count(F.lit(1)).alias("n_records"))


@query("stage_rollup", """WITH c AS (SELECT c.session_id, s.seg_no, c.name FROM v_call c JOIN d_seg s ON s.session_id = c.session_id AND c.idx BETWEEN start_idx AND end_idx),
    k AS (SELECT session_id, seg_no, count(*) AS n, string_agg(name || '=' || m, ',' ORDER BY name) AS l FROM (SELECT session_id, seg_no, name, count(*) AS m FROM c GROUP BY ALL) GROUP BY session_id, seg_no),
    n AS (SELECT session_id, seg_no, CAST(sum(m) AS BIGINT) AS calls FROM (SELECT session_id, seg_no, count(*) AS m FROM c GROUP BY ALL) GROUP BY ALL),
    u AS (SELECT u.session_id, s.seg_no, CAST(sum(out_tok) AS BIGINT) AS o, CAST(sum(cread) AS BIGINT) AS r, count(*) AS q FROM d_settled u JOIN d_seg s ON s.session_id = u.session_id AND u.idx BETWEEN start_idx AND end_idx GROUP BY ALL)
    SELECT s.session_id, s.seg_no, s.stage, s.end_idx - s.start_idx + 1 AS n_records, coalesce(n.calls, 0) AS tool_calls, coalesce(k.l, '') AS tool_counts, coalesce(u.q, 0) AS requests, coalesce(u.o, 0) AS output_tokens, coalesce(u.r, 0) AS cache_read_tokens, s.end_ms - s.start_ms AS duration_ms
    FROM d_seg s LEFT JOIN k USING (session_id, seg_no) LEFT JOIN n USING (session_id, seg_no) LEFT JOIN u USING (session_id, seg_no)""")
def stage_rollup(spark, d):
    segs = seg(spark, d)
    calls = segments.asof(frame(spark, d, "v_call").select("session_id", "idx", "name"), segs).groupBy("session_id", "seg_no", "name").agg(F.count(F.lit(1)).alias("m"))
    calls = calls.groupBy("session_id", "seg_no").agg(F.sum("m").alias("tool_calls"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "m"))), ",").alias("tool_counts"))
    use = segments.asof(usage.settle(frame(spark, d, "v_usage")).select("session_id", "idx", "out_tok", "cread"), segs).groupBy("session_id", "seg_no").agg(F.count(F.lit(1)).alias("requests"), F.sum("out_tok").alias("output_tokens"), F.sum("cread").alias("cache_read_tokens"))
    on = ["session_id", "seg_no"]
    out = segs.join(calls, on, "left").join(use, on, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*on, "stage", (F.col("end_idx") - F.col("start_idx") + 1).alias("n_records"), zero("tool_calls"), F.coalesce("tool_counts", F.lit("")).alias("tool_counts"), zero("requests"), zero("output_tokens"), zero("cache_read_tokens"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


@query("session_totals", """WITH r AS (SELECT session_id, count(*) AS n, max(t_ms) - min(t_ms) AS span_ms, count_if(event_type = 'error') AS errors FROM v_rec GROUP BY session_id),
    p AS (SELECT session_id, count(*) AS calls, count_if(ok = false) AS fails, count(DISTINCT name) AS tools FROM d_pair GROUP BY session_id),
    u AS (SELECT session_id, CAST(sum(out_tok) AS BIGINT) AS o, count(*) AS q, max(inp + cread + cw5 + cw1h) AS peak FROM d_settled GROUP BY session_id),
    f AS (SELECT session_id, count(DISTINCT path) AS files FROM v_write GROUP BY session_id), q AS (SELECT session_id, CAST(sum(dur_ms) AS BIGINT) AS question_ms FROM d_pair WHERE name = 'tool4' AND dur_ms > 0 GROUP BY session_id), a AS (SELECT session_id, count(*) AS agents, count_if(k % 10 = 0) AS aborted_agents, CAST(coalesce(sum(k) FILTER (WHERE k % 10 = 0), 0) AS BIGINT) AS waste_output_tokens FROM v_rec WHERE event_type = 'purchase' GROUP BY session_id), t AS (SELECT session_id, CAST(sum(duration_ms - least(st, duration_ms)) AS BIGINT) AS active_ms, CAST(sum(least(wa, st, duration_ms)) AS BIGINT) AS wait_ms, count(*) AS stages FROM d_time GROUP BY session_id)
    SELECT r.session_id, r.n AS n_records, r.span_ms, r.errors, coalesce(calls, 0) AS tool_calls, coalesce(fails, 0) AS fails, coalesce(tools, 0) AS tools, o AS output_tokens, q AS requests, peak AS ctx_peak, coalesce(files, 0) AS files_touched, active_ms, wait_ms, stages, coalesce(question_ms, 0) AS question_ms, coalesce(agents, 0) AS agents, coalesce(aborted_agents, 0) AS aborted_agents, coalesce(waste_output_tokens, 0) AS waste_output_tokens
    FROM r LEFT JOIN q USING (session_id) LEFT JOIN a USING (session_id) LEFT JOIN p USING (session_id) LEFT JOIN u USING (session_id) LEFT JOIN f USING (session_id) LEFT JOIN t USING (session_id)""")
def session_totals(spark, d):
    """Purchases are agents; one whose number of tokens is divisible by ten broke off."""
    k = "session_id"
    r = frame(spark, d, "v_rec").groupBy(k).agg(F.count(F.lit(1)).alias("n_records"), (F.max("t_ms") - F.min("t_ms")).alias("span_ms"), F.count_if(F.col("event_type") == "error").alias("errors"))
    p = pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result")).groupBy(k).agg(F.count(F.lit(1)).alias("tool_calls"), F.count_if(~F.col("ok")).alias("fails"), F.count_distinct("name").alias("tools"))
    u = usage.settle(frame(spark, d, "v_usage")).groupBy(k).agg(F.sum("out_tok").alias("output_tokens"), F.count(F.lit(1)).alias("requests"), F.max(F.col("inp") + F.col("cread") + F.col("cw5") + F.col("cw1h")).alias("ctx_peak"))
    f = frame(spark, d, "v_write").groupBy(k).agg(F.count_distinct("path").alias("files_touched"))
    t = segments.time_accounts(pieces(spark, d), seg(spark, d)).groupBy(k).agg(F.sum("active_ms").alias("active_ms"), F.sum("wait_ms").alias("wait_ms"), F.count(F.lit(1)).alias("stages"))
    q = segments.question_stalls(_tools(spark, d), question="tool4").groupBy(k).agg(F.sum(F.col("b_ms") - F.col("a_ms")).alias("question_ms"))
    lives = frame(spark, d, "v_rec").filter("event_type = 'purchase'").select(k, F.when(F.col("k") % 10 == 0, "interrupted").alias("aborted"), F.col("k").alias("output_tokens"))
    a = agents.waste(lives, k).select(k, "agents", "aborted_agents", "waste_output_tokens")
    out = r.join(p, k, "left").join(u, k, "left").join(f, k, "left").join(t, k, "left").join(q, k, "left").join(a, k, "left")
    return out.fillna(0, ["tool_calls", "fails", "tools", "files_touched", "question_ms", "agents", "aborted_agents", "waste_output_tokens"])


DERIVED["d_agent"] = """WITH e AS (SELECT session_id, CASE WHEN arg_max(event_type, idx) <> 'purchase' THEN 'interrupted' WHEN arg_max(k, idx) % 2 = 0 THEN 'api_error' END AS aborted FROM v_rec GROUP BY session_id),
    c AS (SELECT session_id, string_agg(name || '=' || m, ',' ORDER BY name) AS tool_counts FROM (SELECT session_id, name, count(*) AS m FROM d_pair GROUP BY ALL) GROUP BY session_id),
    u AS (SELECT session_id, CAST(sum(out_tok) AS BIGINT) AS output_tokens FROM d_settled GROUP BY session_id), s AS (SELECT session_id, string_agg(DISTINCT skill, ',' ORDER BY skill) AS skills FROM v_stage_mark WHERE skill IS NOT NULL GROUP BY session_id),
    t AS (SELECT session_id, 'done ' || arg_max(event_id, idx) AS last_text FROM v_rec WHERE event_type = 'purchase' GROUP BY session_id),
    p AS (SELECT session_id, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS tool_uses, string_agg(DISTINCT name, ',' ORDER BY name) AS tools, count_if(ok) AS n_ok, count_if(ok = false) AS n_failed, count_if(ok IS NULL) AS n_open FROM d_pair GROUP BY session_id)
    SELECT p.*, tool_counts, coalesce(output_tokens, 0) AS output_tokens, last_text, coalesce(skills, '') AS skills, aborted FROM p JOIN c USING (session_id) LEFT JOIN u USING (session_id) LEFT JOIN s USING (session_id) LEFT JOIN t USING (session_id) LEFT JOIN e USING (session_id)"""


@query("agent_rollup", "SELECT * FROM d_agent")
def agent_rollup(spark, d):
    """Sessions are agents: a purchase is a text of the agent, and one that ends on another record was interrupted."""
    r = frame(spark, d, "v_rec")
    last = r.groupBy("session_id").agg(F.max_by(F.struct("event_type", "k"), "idx").alias("l"))
    role, text = F.when(F.col("l.event_type") == "purchase", "assistant").otherwise("user"), F.when(F.col("l.k") % 2 == 0, "API Error: connection lost").otherwise("done")
    ends = last.select("session_id", records.abort_reason(role, text, F.lit(None).cast("string")).alias("aborted"))
    said = r.filter("event_type = 'purchase'").select("session_id", "idx", F.concat(F.lit("done "), F.col("event_id").cast("string")).alias("text"))
    tools = pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result"))
    return agents.rollup(tools, usage.settle(frame(spark, d, "v_usage")), said, frame(spark, d, "v_stage_mark").filter("skill is not null"), ends)


@query("agent_waste", "SELECT session_id % 10 AS lineage, count(*) AS agents, count(aborted) AS aborted_agents, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN aborted IS NOT NULL THEN output_tokens ELSE 0 END) AS BIGINT) AS waste_output_tokens FROM d_agent GROUP BY 1")
def agent_waste(spark, d):
    return agents.waste(agent_rollup(spark, d).withColumn("lineage", F.col("session_id") % 10), "lineage")


@query("block_chars", "SELECT session_id, msg_id, ch_think, ch_text, ch_tool FROM d_settled")
def block_chars(spark, d):
    return frame(spark, d, "v_usage").groupBy("session_id", "msg_id").agg(*[F.sum(c).alias(c) for c in ("ch_think", "ch_text", "ch_tool")])


@query("peak_parallel", """WITH e AS (SELECT session_id, a_ms AS t, 1 AS d FROM v_busy UNION ALL SELECT session_id, b_ms, -1 FROM v_busy), o AS (SELECT session_id, sum(d) OVER (PARTITION BY session_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT session_id, CAST(max(k) AS BIGINT) AS peak, (SELECT max(b_ms - a_ms) FROM v_busy b WHERE b.session_id = o.session_id) AS longest_ms FROM o GROUP BY session_id""")
def peak_parallel(spark, d):
    return intervals.parallelism(frame(spark, d, "v_busy"), ["session_id"], "a_ms", "b_ms")


@query("idle_gaps", "SELECT session_id, b_ms AS gap_a, n AS gap_b FROM (SELECT *, lead(a_ms) OVER (PARTITION BY session_id ORDER BY a_ms) AS n FROM d_busy) WHERE n > b_ms")
def idle_gaps(spark, d):
    return intervals.gaps(busy_union(spark, d), ["session_id"], "a_ms", "b_ms")


@query("topology", "SELECT c.session_id, s.seg_no, s.stage, c.name, count(*) AS n FROM v_call c JOIN d_seg s ON s.session_id = c.session_id AND c.idx BETWEEN start_idx AND end_idx GROUP BY ALL")
def topology(spark, d):
    return segments.asof(frame(spark, d, "v_call").select("session_id", "idx", "name"), seg(spark, d)).groupBy("session_id", "seg_no", "stage", "name").agg(F.count(F.lit(1)).alias("n"))


@query("skill_calls", "SELECT name, count(*) AS calls, count_if(session_id % 10 = 0) AS main_calls, count_if(session_id % 10 <> 0) AS sub_calls, count_if(ok = false) AS failures, CAST(sum(dur_ms) AS BIGINT) AS dur_ms, max(dur_ms) AS longest_ms FROM d_pair GROUP BY name")
def skill_calls(spark, d):
    """Each tenth session is a main thread, the others are its sub-agents."""
    calls = pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result"))
    return agents.skill_stats(calls.withColumn("is_main", F.col("session_id") % 10 == 0))


@query("record_density", """SELECT session_id, count(*) AS n, max(g) AS max_gap_ms, CAST(sum(g) AS BIGINT) AS span_ms, round(quantile_cont(g, 0.5), 3) AS p50_gap_ms, round(quantile_cont(g, 0.9), 3) AS p90_gap_ms FROM (SELECT session_id, t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM v_rec) GROUP BY session_id""")
def record_density(spark, d):
    return ms_between(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("gap_ms").alias("max_gap_ms"), F.sum("gap_ms").alias("span_ms"), *[F.round(F.percentile("gap_ms", F.lit(q)), 3).alias(f"p{round(q * 100)}_gap_ms") for q in (0.5, 0.9)])
