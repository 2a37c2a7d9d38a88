"""Queries of lineage, coverage and the comparison of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import paths
from tracelake.operators import digest as digests
from tracelake.operators import lineage, pairs, replay, segments, usage
from tracelake.plans.core import pieces, seg
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
    "d_read": "SELECT session_id % 10 AS lineage, session_id, idx, event_type, path, start_line, n FROM v_read_span",
    "d_line": "SELECT lineage, session_id, idx, path, unnest(range(start_line, start_line + n)) AS l FROM d_read WHERE n > 0",
    "d_in": "SELECT d.*, i.is_code, i.n_lines FROM d_line d JOIN v_inventory i ON lower(i.path) = lower(d.path) AND d.l <= i.n_lines",
    "d_dropped": "SELECT session_id FROM v_rec GROUP BY session_id HAVING arg_max(event_type, idx) = 'error' AND session_id NOT IN (SELECT session_id FROM v_write)",
    "d_read_seg": "SELECT r.*, s.seg_no, s.stage FROM d_read r JOIN d_seg s ON s.session_id = r.session_id AND r.idx BETWEEN s.start_idx AND s.end_idx",
    "d_write_seg": "SELECT w.*, s.seg_no, s.stage FROM v_write w JOIN d_seg s ON s.session_id = w.session_id AND w.idx BETWEEN s.start_idx AND s.end_idx",
}


def reads(spark, d) -> DataFrame:
    return frame(spark, d, "v_read_span").withColumn("lineage", F.col("session_id") % 10)


def read_segs(spark, d) -> DataFrame:
    return segments.asof(reads(spark, d), seg(spark, d))


def write_segs(spark, d) -> DataFrame:
    return segments.asof(frame(spark, d, "v_write"), seg(spark, d))


@query("unread_files", "SELECT s.lineage, i.path FROM (SELECT DISTINCT lineage FROM d_read) s, v_inventory i WHERE NOT EXISTS (SELECT 1 FROM d_read r WHERE r.lineage = s.lineage AND lower(r.path) = lower(i.path))")
def unread_files(spark, d):
    return lineage.unread(frame(spark, d, "v_inventory"), reads(spark, d).withColumn("path", F.upper("path")))


@query("out_of_scope", "SELECT DISTINCT lineage, path FROM d_read r WHERE NOT EXISTS (SELECT 1 FROM v_inventory i WHERE lower(i.path) = lower(r.path))")
def out_of_scope(spark, d):
    return lineage.out_of_scope(reads(spark, d), frame(spark, d, "v_inventory"), ["lineage"])


@query("coverage", """WITH c AS (SELECT session_id, count(DISTINCT path) AS files, count(DISTINCT path || ':' || l) AS lines FROM d_in GROUP BY session_id)
    SELECT s.session_id, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines, (SELECT count(*) FROM v_inventory) AS total_files, (SELECT CAST(sum(n_lines) AS BIGINT) FROM v_inventory) AS total_lines FROM (SELECT DISTINCT session_id FROM d_read) s LEFT JOIN c ON c.session_id = s.session_id""")
def coverage(spark, d):
    return lineage.coverage(reads(spark, d), frame(spark, d, "v_inventory"), ["session_id"])


@query("probe_only", "SELECT lineage, stage, count(*) AS files FROM (SELECT DISTINCT lineage, stage, path FROM d_read_seg v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM d_read_seg c WHERE c.event_type = 'click' AND c.lineage = v.lineage AND c.stage = v.stage AND c.path = v.path)) GROUP BY ALL")
def probe_only(spark, d):
    r = read_segs(spark, d)
    on = ["lineage", "stage", "path"]
    probed, seen = r.filter("event_type = 'view'").select(*on).distinct(), r.filter("event_type = 'click'").select(*on)
    return probed.join(seen, on, "left_anti").groupBy("lineage", "stage").agg(F.count(F.lit(1)).alias("files"))


@query("read_accum", "SELECT session_id, path, count(*) FILTER (WHERE l = start_line) AS reads, count(*) AS lines_cum, max(l) AS last_line, count(DISTINCT l) AS lines_dedup, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, max(total) AS max_total FROM (SELECT session_id, path, event_type, start_line, start_line + idx AS total, unnest(range(start_line, start_line + n)) AS l FROM v_read_span WHERE n > 0) GROUP BY session_id, path")
def read_accum(spark, d):
    return lineage.accumulate(reads(spark, d).withColumn("total", F.col("start_line") + F.col("idx")), ["session_id", "path"], "event_type", "total")


def _dropped(spark, d) -> DataFrame:
    last = frame(spark, d, "v_rec").groupBy("session_id").agg(F.max_by("event_type", "idx").alias("t")).filter("t = 'error'")
    return last.join(frame(spark, d, "v_write"), "session_id", "left_anti").select("session_id")


@query("lineage_edges", """WITH b AS (SELECT DISTINCT lineage, path, session_id, 'r' AS k FROM d_read UNION SELECT DISTINCT lineage, path, session_id, 'w' FROM v_write), c AS (SELECT * FROM b WHERE session_id NOT IN (SELECT session_id FROM d_dropped))
    SELECT lineage, path, coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER (WHERE k = 'r'), '') AS readers, coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER (WHERE k = 'w'), '') AS writers FROM c GROUP BY lineage, path""")
def lineage_edges(spark, d):
    return lineage.edges(reads(spark, d), frame(spark, d, "v_write"), _dropped(spark, d))


@query("probe_edges", """WITH b AS (SELECT DISTINCT lineage, path, session_id, CASE event_type WHEN 'click' THEN 'r' ELSE 'p' END AS k FROM d_read UNION SELECT DISTINCT lineage, path, session_id, 'w' FROM v_write), c AS (SELECT * FROM b WHERE session_id NOT IN (SELECT session_id FROM d_dropped) AND path NOT LIKE '%7')
    SELECT lineage, path, coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER (WHERE k = 'r'), '') AS readers, coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER (WHERE k = 'w'), '') AS writers,
    coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER (WHERE k = 'p'), '') AS probed_by FROM c GROUP BY lineage, path""")
def probe_edges(spark, d):
    """Clicks read, views only probe; files whose name ends in 7 lie in a folder of tools."""
    r = reads(spark, d)
    outside = paths.is_external(F.when(F.col("path").endswith("7"), F.concat(F.lit("/home/u/.claude/"), "path")).otherwise(F.col("path")))
    return lineage.edges(r.filter("event_type = 'click'"), frame(spark, d, "v_write"), _dropped(spark, d), probed=r.filter("event_type = 'view'"), external=outside)


_AGENT = "CASE WHEN idx % 3 = 0 THEN '__main__:' || stage ELSE 'a' || (idx % 3) END"
DERIVED |= {
    "d_agent_line": f"SELECT session_id, {_AGENT} AS agent_id, path, event_type, unnest(range(start_line, start_line + n)) AS l FROM d_read_seg WHERE n > 0",
    "d_agent_write": f"SELECT session_id, {_AGENT} AS agent_id, path, greatest(val, 0) AS added, CASE path WHEN 'w0' THEN 'ets' WHEN 'w1' THEN 'spec' WHEN 'w2' THEN 'plan' END AS kind FROM d_write_seg",
}


def _by_agent(rows: DataFrame) -> DataFrame:
    """Every third record is the main thread's, the others are those of two agents."""
    return lineage.main_agents(rows, F.col("idx") % 3 == 0, F.concat(F.lit("a"), (F.col("idx") % 3).cast("string")))


@query("agent_rows", """WITH r AS (SELECT session_id, agent_id, count(DISTINCT path) AS n_read, count(*) AS lines_cum, count(DISTINCT path || ':' || l) AS lines_dedup FROM d_agent_line GROUP BY ALL),
    w AS (SELECT session_id, agent_id, count(DISTINCT path) AS n_out, count(DISTINCT path) FILTER (WHERE kind = 'ets') AS n_ets, count(DISTINCT path) FILTER (WHERE kind = 'spec') AS n_spec, count(DISTINCT path) FILTER (WHERE kind = 'plan') AS n_plan, CAST(sum(added) AS BIGINT) AS lines_added, CAST(coalesce(sum(added) FILTER (WHERE kind = 'ets'), 0) AS BIGINT) AS lines_ets FROM d_agent_write GROUP BY ALL),
    a AS (SELECT session_id, agent_id FROM r UNION SELECT session_id, agent_id FROM w)
    SELECT a.session_id, a.agent_id, coalesce(n_read, 0) AS n_read, coalesce(lines_cum, 0) AS lines_cum, coalesce(lines_dedup, 0) AS lines_dedup, coalesce(n_out, 0) AS n_out, coalesce(n_ets, 0) AS n_ets, coalesce(n_spec, 0) AS n_spec, coalesce(n_plan, 0) AS n_plan, coalesce(lines_added, 0) AS lines_added, coalesce(lines_ets, 0) AS lines_ets,
    CASE WHEN n_ets > 0 THEN 'execute' WHEN n_spec > 0 THEN 'spec' WHEN n_plan > 0 THEN 'plan' ELSE 'other' END AS role FROM a LEFT JOIN r USING (session_id, agent_id) LEFT JOIN w USING (session_id, agent_id)""")
def agent_rows(spark, d):
    kind = F.when(F.col("path") == "w0", "ets").when(F.col("path") == "w1", "spec").when(F.col("path") == "w2", "plan")
    return lineage.agent_rows(_by_agent(read_segs(spark, d)), _by_agent(write_segs(spark, d)), ["session_id", "agent_id"], kind)


@query("agent_spans", """WITH d AS (SELECT DISTINCT session_id, agent_id, path, l FROM d_agent_line), g AS (SELECT *, l - row_number() OVER (PARTITION BY session_id, agent_id, path ORDER BY l) AS g FROM d),
    v AS (SELECT session_id, agent_id, path, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS via FROM d_agent_line GROUP BY ALL)
    SELECT g.session_id, g.agent_id, g.path, min(l) AS start_line, max(l) AS end_line, any_value(via) AS via FROM g JOIN v ON v.session_id = g.session_id AND v.agent_id = g.agent_id AND v.path = g.path GROUP BY g.session_id, g.agent_id, g.path, g.g""")
def agent_spans(spark, d):
    return lineage.agent_spans(_by_agent(read_segs(spark, d)), ["session_id", "agent_id"], "event_type")


@query("doc_universe", "SELECT DISTINCT lineage, path FROM (SELECT lineage, path FROM d_read UNION SELECT lineage, path FROM v_write)")
def doc_universe(spark, d):
    return reads(spark, d).select("lineage", "path").union(frame(spark, d, "v_write").select("lineage", "path")).distinct()


@query("agent_lineage", """WITH w AS (SELECT session_id, count(DISTINCT path) AS n_out, bool_or(path = 'w0') AS a, bool_or(path = 'w1') AS b, bool_or(path = 'w2') AS c FROM v_write GROUP BY session_id),
    r AS (SELECT session_id, count(DISTINCT path) AS n_read, count(*) AS lines_cum, count(DISTINCT path || ':' || l) AS lines_dedup FROM d_line GROUP BY session_id)
    SELECT coalesce(r.session_id, w.session_id) AS session_id, CASE WHEN a THEN 'execute' WHEN b THEN 'spec' WHEN c THEN 'plan' ELSE 'other' END AS role, coalesce(n_read, 0) AS n_read, coalesce(lines_cum, 0) AS lines_cum, coalesce(lines_dedup, 0) AS lines_dedup, coalesce(n_out, 0) AS n_out FROM r FULL JOIN w ON w.session_id = r.session_id""")
def agent_lineage(spark, d):
    w = frame(spark, d, "v_write").groupBy("session_id").agg(F.count_distinct("path").alias("n_out"), *[F.bool_or(F.col("path") == p).alias(p) for p in ("w0", "w1", "w2")])
    acc = lineage.accumulate(reads(spark, d), ["session_id", "path"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_read"), F.sum("lines_cum").alias("lines_cum"), F.sum("lines_dedup").alias("lines_dedup"))
    out = acc.join(w, "session_id", "full")
    role = F.when(F.col("w0"), "execute").when(F.col("w1"), "spec").when(F.col("w2"), "plan").otherwise("other")
    return out.select("session_id", role.alias("role"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_read", "lines_cum", "lines_dedup", "n_out")])


DERIVED["d_view"] = """WITH a AS (SELECT lineage, stage, count(DISTINCT path) AS files, count(DISTINCT session_id) AS agents, CAST(sum(n) AS BIGINT) AS lines_cum FROM d_read_seg WHERE n > 0 GROUP BY ALL),
    l AS (SELECT r.lineage, r.stage, r.path, i.is_code, i.n_lines, l FROM (SELECT lineage, stage, path, unnest(range(start_line, start_line + n)) AS l FROM d_read_seg WHERE n > 0) r JOIN v_inventory i ON i.path = r.path AND l <= i.n_lines),
    b AS (SELECT lineage, stage, count(DISTINCT path || ':' || l) AS lines_dedup, count(DISTINCT path || ':' || l) FILTER (WHERE is_code) AS code_lines FROM l GROUP BY ALL),
    t AS (SELECT lineage, stage, CAST(sum(n_lines) AS BIGINT) AS lines_touched FROM (SELECT DISTINCT lineage, stage, path, n_lines FROM l) GROUP BY ALL)
    SELECT a.lineage, a.stage, files, agents, lines_cum, coalesce(lines_dedup, 0) AS lines_dedup, coalesce(code_lines, 0) AS code_lines, coalesce(lines_touched, 0) AS lines_touched FROM a LEFT JOIN b USING (lineage, stage) LEFT JOIN t USING (lineage, stage)"""


@query("stage_view", "SELECT * FROM d_view")
def stage_view(spark, d):
    return lineage.stage_view(read_segs(spark, d), frame(spark, d, "v_inventory"), ["lineage", "stage"])


@query("read_depth", "SELECT lineage, stage, round(lines_dedup / (SELECT sum(n_lines) FROM v_inventory), 6) AS coverage, round(lines_dedup / nullif(lines_touched, 0), 6) AS depth, lines_cum - lines_dedup AS reread FROM d_view")
def read_depth(spark, d):
    total = frame(spark, d, "v_inventory").agg(F.sum("n_lines").alias("t"))
    v = stage_view(spark, d).crossJoin(F.broadcast(total))
    return v.select("lineage", "stage", F.round(F.col("lines_dedup") / F.col("t"), 6).alias("coverage"), F.round(F.try_divide("lines_dedup", "lines_touched"), 6).alias("depth"), (F.col("lines_cum") - F.col("lines_dedup")).alias("reread"))


_FOLD = """WITH RECURSIVE o AS (SELECT lineage, path, kind, val, stage, row_number() OVER (PARTITION BY lineage, path ORDER BY t_ms, session_id, idx) AS n FROM d_write_seg),
    x AS (SELECT lineage, path, n, stage, CASE WHEN kind = 'set' THEN val ELSE greatest(0, val) END AS lines FROM o WHERE n = 1
    UNION ALL SELECT o.lineage, o.path, o.n, o.stage, CASE WHEN o.kind = 'set' THEN o.val ELSE greatest(0, x.lines + o.val) END FROM x JOIN o ON o.lineage = x.lineage AND o.path = x.path AND o.n = x.n + 1)"""


@query("output_by_stage", f"""{_FOLD}, f AS (SELECT lineage, path, arg_max(stage, n) AS stage, arg_max(lines, n) AS lines FROM x GROUP BY lineage, path), g AS (SELECT lineage, stage, CAST(sum(lines) AS BIGINT) AS final_lines FROM f GROUP BY ALL),
    w AS (SELECT lineage, stage, CAST(sum(greatest(val, 0)) AS BIGINT) AS written, count(DISTINCT path) AS files, count(DISTINCT session_id) AS agents FROM d_write_seg GROUP BY ALL)
    SELECT w.lineage, w.stage, written, files, agents, coalesce(final_lines, 0) AS final_lines FROM w LEFT JOIN g USING (lineage, stage)""")
def output_by_stage(spark, d):
    order = ["t_ms", "session_id", "idx"]
    w = write_segs(spark, d)
    own = lineage.owned_lines(replay.replay(w, ["lineage", "path"], order), ["lineage"], "path", order)
    made = w.groupBy("lineage", "stage").agg(F.sum(F.greatest(F.col("val"), F.lit(0))).alias("written"), F.count_distinct("path").alias("files"), F.count_distinct("session_id").alias("agents"))
    return made.join(own, ["lineage", "stage"], "left").select("lineage", "stage", "written", "files", "agents", F.coalesce("final_lines", F.lit(0)).alias("final_lines"))


DERIVED["d_stats"] = """WITH a AS (SELECT lineage, count(DISTINCT path) AS read_files, count(DISTINCT session_id) AS readers, CAST(sum(n) AS BIGINT) AS lines_cum FROM d_read WHERE n > 0 GROUP BY lineage),
    b AS (SELECT lineage, count(DISTINCT path) AS in_files, count(DISTINCT path || ':' || l) AS in_lines FROM d_in GROUP BY lineage), w AS (SELECT lineage, count(*) AS writes, count(DISTINCT path) AS written_files, count(DISTINCT session_id) AS writers FROM v_write GROUP BY lineage)
    SELECT a.lineage, read_files, readers, lines_cum, coalesce(in_files, 0) AS in_files, coalesce(in_lines, 0) AS in_lines, coalesce(writes, 0) AS writes, coalesce(written_files, 0) AS written_files, coalesce(writers, 0) AS writers FROM a LEFT JOIN b USING (lineage) LEFT JOIN w USING (lineage)"""


@query("lineage_stats", "SELECT * FROM d_stats")
def lineage_stats(spark, d):
    r = reads(spark, d).filter("n > 0")
    a = r.groupBy("lineage").agg(F.count_distinct("path").alias("read_files"), F.count_distinct("session_id").alias("readers"), F.sum("n").alias("lines_cum"))
    b = lineage.coverage(r, frame(spark, d, "v_inventory"), ["lineage"]).select("lineage", F.col("files").alias("in_files"), F.col("lines").alias("in_lines"))
    w = frame(spark, d, "v_write").groupBy("lineage").agg(F.count(F.lit(1)).alias("writes"), F.count_distinct("path").alias("written_files"), F.count_distinct("session_id").alias("writers"))
    return a.join(b, "lineage", "left").join(w, "lineage", "left").fillna(0, ["writes", "written_files", "writers"])


@query("handoff_gap", """WITH c AS (SELECT s.session_id, coalesce(min(s.seg_no) FILTER (WHERE s.stage = 'plan'), (SELECT min(seg_no) FROM d_write_seg w WHERE w.session_id = s.session_id AND w.path <> 'w0')) AS cut FROM d_seg s GROUP BY s.session_id),
    r AS (SELECT DISTINCT r.session_id, cut, path, seg_no <= cut AS up FROM d_read_seg r JOIN c ON c.session_id = r.session_id WHERE cut IS NOT NULL), l AS (SELECT session_id, cut, path FROM r GROUP BY ALL HAVING bool_and(up))
    SELECT session_id, cut, count(*) AS lost_files, string_agg(path, ',' ORDER BY path) AS lost FROM l GROUP BY session_id, cut""")
def handoff_gap(spark, d):
    """What is written to w0 is written by the main thread, the rest by sub-agents."""
    cuts = lineage.handoff(seg(spark, d), write_segs(spark, d), by_agent=F.col("path") != "w0")
    return lineage.lost(read_segs(spark, d), cuts).groupBy("session_id", "cut").agg(F.count(F.lit(1)).alias("lost_files"), lineage.joined("path").alias("lost"))


@query("module_coverage", "SELECT CAST(length(path) - 1 AS BIGINT) AS module, count(*) AS total, count_if(EXISTS (SELECT 1 FROM d_read r WHERE r.path = i.path AND n > 0)) AS read FROM v_inventory i GROUP BY 1")
def module_coverage(spark, d):
    seen = reads(spark, d).filter("n > 0").select("path").distinct().withColumn("seen", F.lit(True))
    inv = frame(spark, d, "v_inventory").join(seen, "path", "left")
    return inv.groupBy((F.length("path") - 1).cast("long").alias("module")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("seen", F.lit(False))).alias("read"))


@query("lineage_chain", "SELECT r.path AS source, w.path AS output, count(DISTINCT r.session_id) AS agents FROM (SELECT DISTINCT session_id, path FROM d_read) r JOIN (SELECT DISTINCT session_id, path FROM v_write) w ON w.session_id = r.session_id GROUP BY ALL")
def lineage_chain(spark, d):
    r = reads(spark, d).select("session_id", F.col("path").alias("source")).distinct()
    w = frame(spark, d, "v_write").select("session_id", F.col("path").alias("output")).distinct()
    return r.join(w, "session_id").groupBy("source", "output").agg(F.count_distinct("session_id").alias("agents"))


@query("lineage_chain_documents", """WITH a AS (SELECT lineage, source, document, count(*) AS first_agents FROM (SELECT DISTINCT lineage, session_id, path AS source FROM d_read) r JOIN (SELECT DISTINCT session_id, path AS document FROM v_write) w USING (session_id) GROUP BY ALL),
    b AS (SELECT lineage, document, output, count(*) AS second_agents FROM (SELECT DISTINCT session_id % 10 AS lineage, session_id, 'w' || (event_id % 4) AS document FROM v_rec WHERE event_type = 'view') r JOIN (SELECT DISTINCT session_id, path AS output FROM v_write) w USING (session_id) WHERE document <> output GROUP BY ALL)
    SELECT a.lineage, source, a.document, output, first_agents, second_agents FROM a JOIN b ON b.lineage = a.lineage AND b.document = a.document""")
def lineage_chain_documents(spark, d):
    """Views hand over documents that others of the lineage write."""
    handed = frame(spark, d, "v_rec").filter("event_type = 'view'").select((F.col("session_id") % 10).alias("lineage"), "session_id", F.concat(F.lit("w"), (F.col("event_id") % 4).cast("string")).alias("path"))
    return lineage.chain(reads(spark, d), frame(spark, d, "v_write"), handed)


DERIVED["d_digest"] = """WITH s AS (SELECT session_id, count_if(stage <> 'setup') AS stages, max(end_ms) - min(start_ms) AS dur_ms FROM d_seg GROUP BY session_id), p AS (SELECT session_id, count(*) AS calls, count_if(ok = false) AS fails FROM d_pair GROUP BY session_id),
    u AS (SELECT session_id, count(*) AS req, CAST(sum(out_tok) AS BIGINT) AS out_total, max(inp + cread + cw5 + cw1h) AS ctx_peak FROM d_settled GROUP BY session_id), c AS (SELECT session_id, round(sum(usd_in + usd_read + usd_write + usd_out), 9) AS usd FROM d_cost GROUP BY session_id)
    SELECT s.session_id, stages, dur_ms, coalesce(calls, 0) AS calls, coalesce(fails, 0) AS fails, req, out_total, ctx_peak, usd FROM s LEFT JOIN p USING (session_id) JOIN u USING (session_id) JOIN c USING (session_id)"""
_SPARK_POINTS = """SELECT session_id, string_agg(CAST(ctx AS VARCHAR), ',' ORDER BY i) AS spark FROM (SELECT session_id, ctx, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n
    FROM (SELECT session_id, idx, inp + cread + cw5 + cw1h AS ctx FROM d_settled)) WHERE i % greatest(1, n // 140) = 0 OR i = n - 1 GROUP BY session_id"""


def _digest(spark, d) -> DataFrame:
    k = "session_id"
    s = seg(spark, d).groupBy(k).agg(F.count_if(F.col("stage") != "setup").alias("stages"), (F.max("end_ms") - F.min("start_ms")).alias("dur_ms"))
    p = pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result")).groupBy(k).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("fails"))
    settled = usage.settle(frame(spark, d, "v_usage"))
    u = settled.groupBy(k).agg(F.count(F.lit(1)).alias("req"), F.sum("out_tok").alias("out_total"), F.max(F.col("inp") + F.col("cread") + F.col("cw5") + F.col("cw1h")).alias("ctx_peak"))
    c = usage.priced(usage.billing(settled)).groupBy(k).agg(F.round(F.sum(F.col("usd_in") + F.col("usd_read") + F.col("usd_write") + F.col("usd_out")), 9).alias("usd"))
    return s.join(p, k, "left").join(u, k).join(c, k).fillna(0, ["calls", "fails"])


@query("digest", f"SELECT d.*, p.spark FROM d_digest d JOIN ({_SPARK_POINTS}) p ON p.session_id = d.session_id")
def digest(spark, d):
    points = lineage.thin(usage.context_timeline(usage.settle(frame(spark, d, "v_usage"))), ["session_id"], "idx", 140)
    line = points.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ctx"))), lambda x: x["ctx"].cast("string")), ",").alias("spark"))
    return _digest(spark, d).join(line, "session_id")


_METRICS = ["stages", "dur_ms", "calls", "fails", "req", "out_total", "ctx_peak"]


@query("compare_overview", f"WITH u AS (UNPIVOT (SELECT session_id, {', '.join(_METRICS)} FROM d_digest) ON {', '.join(_METRICS)} INTO NAME metric VALUE value) SELECT metric, session_id, value, value = min(value) OVER (PARTITION BY metric) AS is_least FROM u")
def compare_overview(spark, d):
    rows = _digest(spark, d).select("session_id", *[F.col(m).cast("long").alias(m) for m in _METRICS]).unpivot("session_id", _METRICS, "metric", "value")
    least = rows.groupBy("metric").agg(F.min("value").alias("least"))  # one row for each metric
    return rows.join(F.broadcast(least), "metric").select("metric", "session_id", "value", (F.col("value") == F.col("least")).alias("is_least"))


@query("skill_matrix", """WITH n AS (SELECT name, session_id, count(*) AS n FROM v_call GROUP BY ALL), t AS (SELECT name FROM n GROUP BY name ORDER BY sum(n) DESC, name LIMIT 16)
    SELECT name, session_id, n, round(n / max(n) OVER (), 6) AS intensity FROM n WHERE name IN (SELECT name FROM t)""")
def skill_matrix(spark, d):
    n = frame(spark, d, "v_call").groupBy("name", "session_id").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("name").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "name").limit(16).select("name")
    rows = n.join(F.broadcast(top), "name")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("n").alias("m")))).select("name", "session_id", "n", F.round(F.col("n") / F.col("m"), 6).alias("intensity"))


@query("stage_share", """WITH o AS (SELECT s.session_id, s.stage, CAST(sum(out_tok) AS BIGINT) AS out_tok FROM d_settled u JOIN d_seg s ON s.session_id = u.session_id AND u.idx BETWEEN start_idx AND end_idx GROUP BY ALL)
    SELECT session_id, stage, out_tok, round(out_tok / nullif(sum(out_tok) OVER (PARTITION BY session_id), 0), 6) AS share FROM o""")
def stage_share(spark, d):
    use = segments.asof(usage.settle(frame(spark, d, "v_usage")).select("session_id", "idx", "out_tok"), seg(spark, d))
    o = use.groupBy("session_id", "stage").agg(F.sum("out_tok").alias("out_tok"))
    return o.select("session_id", "stage", "out_tok", F.round(F.try_divide(F.col("out_tok"), F.sum("out_tok").over(Window.partitionBy("session_id"))), 6).alias("share"))


@query("trace_document")
def trace_document(spark, d):
    """One nested JSON document for each session."""
    k = "session_id"
    nest = lambda df, name: df.groupBy(k).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != k]))).alias(name))
    settled = usage.settle(frame(spark, d, "v_usage"))
    tools = pairs.pair(frame(spark, d, "v_call"), frame(spark, d, "v_result")).select(k, "idx", "tool_id", "name", "ok", "dur_ms")
    parts = [nest(segments.time_accounts(pieces(spark, d), seg(spark, d)), "stages"), nest(tools, "tools"), nest(usage.billing(settled), "billing"), nest(usage.context_timeline(settled).drop("peak"), "context_timeline")]
    out = _digest(spark, d).select(k, F.struct("stages", "dur_ms", "calls", "fails", "req", "out_total", "ctx_peak", "usd").alias("totals"))
    for p in parts:
        out = out.join(p, k, "left")
    return out.select(k, F.to_json(F.struct("totals", "stages", "tools", "billing", "context_timeline")).alias("trace"))


def _names(c: str, most: int) -> str:
    return f"""CASE WHEN len({c}) > 0 THEN '["' || array_to_string(CASE WHEN len({c}) > {most} THEN list_append({c}[1 : {most}], '… ' || (len({c}) - {most}) || ' more') ELSE {c} END, '","') || '"]' ELSE '[]' END"""


DERIVED |= {
    "d_linked": """SELECT lineage, path, coalesce(list(CAST(session_id AS VARCHAR) ORDER BY session_id) FILTER (WHERE k = 'r'), []) AS rd, coalesce(list(CAST(session_id AS VARCHAR) ORDER BY session_id) FILTER (WHERE k = 'w'), []) AS wr
        FROM (SELECT DISTINCT lineage, path, session_id, 'r' AS k FROM d_read UNION SELECT DISTINCT lineage, path, session_id, 'w' FROM v_write) WHERE session_id NOT IN (SELECT session_id FROM d_dropped) GROUP BY ALL""",
    "d_final": f"{_FOLD} SELECT lineage, path, arg_max(lines, n) AS lines FROM x GROUP BY lineage, path",
    "d_outputs": f"""SELECT f.lineage, list('{{"path":"' || f.path || '","final_lines":' || f.lines || ',"writers":' || {_names("wr", 12)} || '}}' ORDER BY f.lines DESC, f.path) AS o FROM d_final f LEFT JOIN d_linked e ON e.lineage = f.lineage AND e.path = f.path GROUP BY f.lineage""",
    "d_documents": f"""SELECT lineage, list('{{"path":"' || path || '","read_by":' || {_names("rd", 12)} || '}}' ORDER BY path) AS s FROM d_linked WHERE len(rd) > 0 GROUP BY lineage""",
    "d_unread": "SELECT s.lineage, list(i.path ORDER BY i.path) AS u FROM (SELECT DISTINCT lineage FROM d_read) s, v_inventory i WHERE NOT EXISTS (SELECT 1 FROM d_read r WHERE r.lineage = s.lineage AND lower(r.path) = lower(i.path)) GROUP BY s.lineage",
    "d_parts": "SELECT t.lineage, (t.lineage + 1) * 4000 AS b, '{\"counts\":{' || " + " || ',' || ".join(f"'\"{c}\":' || t.{c}" for c in ("read_files", "readers", "lines_cum", "in_files", "in_lines", "writes", "written_files", "writers")) + """ || '},"produced_files":[' AS h, coalesce(o, []) AS o, coalesce(s, []) AS s, coalesce(u, []) AS u
        FROM d_stats t LEFT JOIN d_outputs p ON p.lineage = t.lineage LEFT JOIN d_documents q ON q.lineage = t.lineage LEFT JOIN d_unread r ON r.lineage = t.lineage""",
    "d_texts": f"""SELECT lineage, b, h || array_to_string(o, ',') || '],"documents":[' || array_to_string(s, ',') || '],"unread_sample":' || {_names("u", 80)} || '}}' AS one,
        h || array_to_string(o[1 : 40], ',') || '],"documents":[' || array_to_string(s, ',') || '],"unread_sample":' || {_names("u", 30)} || ',"context_truncated":true}}' AS two,
        h || array_to_string(o[1 : 40], ',') || '],"documents":[' || array_to_string(s[1 : 50], ',') || '],"unread_sample":' || {_names("u", 30)} || ',"context_truncated":true}}' AS three FROM d_parts""",
}


@query("context_digest", "SELECT lineage, CASE WHEN length(one) <= b THEN one WHEN length(two) <= b THEN two WHEN length(three) <= b THEN three ELSE substr(three, 1, b - 9) || chr(10) || '… [cut]' || chr(10) END AS digest, length(one) > b AS truncated FROM d_texts")
def context_digest(spark, d):
    """A JSON digest of each lineage within its own budget, which grows with the number of the lineage so that every way of cutting is met."""
    writes = frame(spark, d, "v_write")
    out = replay.final_lines(writes, ["lineage", "path"], ["t_ms", "session_id", "idx"])
    names = lambda df, name: df.join(_dropped(spark, d), "session_id", "left_anti").groupBy("lineage", "path").agg(F.transform(F.array_sort(F.collect_set("session_id")), lambda x: x.cast("string")).alias(name))
    made = out.join(names(writes, "writers"), ["lineage", "path"], "left").select("lineage", "path", "final_lines", F.coalesce("writers", F.array().cast("array<string>")).alias("writers"))
    seen = names(reads(spark, d), "read_by").select("lineage", "path", "read_by")
    return digests.bounded(lineage_stats(spark, d), made, seen, unread_files(spark, d), budget=(F.col("lineage") + 1) * 4000, most_budget=40000)
