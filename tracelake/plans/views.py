"""Transcript-shaped views over the given tables: one text for Spark and for the SQL check.

A view is SQL with three dialect placeholders. ``frame`` builds it in Spark from the
Parquet tables; ``sql`` puts the views that a statement names before it, for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "documents", "benchmark", "conversations", "pages", "part", "customer")

_SPARK = {"K": "CAST(get_json_object(props, '$.k') AS BIGINT)", "MS": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "LINES": "SELECT {id}, CAST(line_no AS BIGINT) AS line_no, text FROM (SELECT {id}, posexplode(split(text, '\\n')) AS (line_no, text) FROM {t})"}
_DUCK = {"K": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "MS": "epoch_us(ts) // 1000", "LINES": "SELECT {id}, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM {t}"}

VIEWS = {
    "v_rec": """SELECT user_id AS session_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
        event_id, {MS} AS t_ms, event_type, value, {K} AS k FROM events""",
    "v_stage_mark": """SELECT session_id, idx, t_ms, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'purchase' THEN 'execute' WHEN 'error' THEN 'verify' END AS skill FROM v_rec""",
    "v_usage": """SELECT session_id, idx, t_ms, CAST(FLOOR(idx / 3) AS BIGINT) AS msg_id, CONCAT('m', CAST(CAST(FLOOR(idx / 3) AS BIGINT) % 3 AS VARCHAR(4))) AS model,
        CAST(FLOOR(value) AS BIGINT) AS inp, k AS cread, k % 7 AS cw5, k % 5 AS cw1h, k AS out_tok, k % 11 AS ch_think, k % 13 AS ch_text, k % 3 AS ch_tool FROM v_rec""",
    "v_call": """SELECT session_id, idx, t_ms, CONCAT('tool', CAST(k % 5 AS VARCHAR(4))) AS name, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx) AS BIGINT) AS tool_id FROM v_rec WHERE event_type = 'click'""",
    "v_result": """SELECT session_id, idx, t_ms, k % 10 <> 0 AS ok, CAST(FLOOR(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx) * 4 / 5) AS BIGINT) AS tool_id FROM v_rec WHERE event_type = 'view'""",
    "v_read_span": """SELECT session_id, idx, event_type, CONCAT('f', CAST(event_id * 13 % (SELECT COUNT(*) FROM part) AS VARCHAR(20))) AS path, 1 + (event_id * 7) % 400 AS start_line, CAST(FLOOR(value) AS BIGINT) % 40 AS n FROM v_rec WHERE event_type IN ('click', 'view')""",
    "v_inventory": """SELECT CONCAT('f', CAST(p_partkey + 4 AS VARCHAR(20))) AS path, CAST(100 + p_size * 5 AS BIGINT) AS n_lines, p_partkey % 2 = 0 AS is_code FROM part""",
    "v_write": """SELECT session_id, session_id % 10 AS lineage, idx, t_ms, CONCAT('w', CAST(event_id % 4 AS VARCHAR(4))) AS path,
        CASE event_type WHEN 'signup' THEN 'set' ELSE 'delta' END AS kind, CASE event_type WHEN 'signup' THEN k + 1 ELSE k - 50 END AS val FROM v_rec WHERE event_type IN ('signup', 'purchase')""",
    "v_turn": """SELECT session_id, idx, t_ms, CASE event_type WHEN 'error' THEN 'close' WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'assistant' ELSE 'other' END AS role FROM v_rec""",
    "v_busy": """SELECT session_id, t_ms AS a_ms, t_ms + CAST(FLOOR(value) AS BIGINT) * 60000 AS b_ms FROM v_rec WHERE event_type = 'view'""",
    "v_counter": """SELECT session_id, idx, event_type, CAST(SUM(k) OVER (PARTITION BY session_id, seg ORDER BY idx) AS BIGINT) AS total
        FROM (SELECT session_id, idx, event_type, k, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS seg FROM v_rec) q""",
    "v_tree": """SELECT c_custkey AS id, CAST(FLOOR(c_custkey / 2) AS BIGINT) AS parent, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS grp, c_mktsegment AS label FROM customer""",
    "v_doc_lines": "{LINES:documents,doc_id}",
    "v_out_lines": "{LINES:benchmark,item_id}",
    "v_shown": "SELECT doc_id AS item_id, line_no, CASE WHEN line_no % 2 = 0 THEN text ELSE CONCAT(text, '  ') END AS text FROM v_doc_lines WHERE doc_id % 20 = 0 AND line_no % 5 <> 4",
}


def _render(text: str, dialect: dict[str, str]) -> str:
    text = re.sub(r"\{LINES:(\w+),(\w+)\}", lambda m: dialect["LINES"].replace("{t}", m[1]).replace("{id}", m[2]), text)
    return text.replace("{K}", dialect["K"]).replace("{MS}", dialect["MS"])


def _needs(text: str, known: dict[str, str], got: dict[str, None]) -> None:
    for name in re.findall(r"\b\w+\b", text):
        if name in known and name not in got and known[name] != text:  # a recursive one names itself
            _needs(known[name], known, got)
            got[name] = None


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    got: dict[str, None] = {}
    _needs(text, VIEWS, got)
    parts = [f"{v} AS ({_render(VIEWS[v], _SPARK)})" for v in got]
    bases = {b for b in BASE if re.search(rf"\b{b}\b", " ".join([text, *parts]))}
    head = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in sorted(bases)]
    return spark.sql(f"WITH {', '.join(head + parts)} {_render(text, _SPARK)}")


#: Derived results that several checks build on, in DuckDB's SQL.
DERIVED: dict[str, str] = {}


def sql(text: str) -> str:
    """``text`` for DuckDB, with the views and derived results that it names."""
    known = VIEWS | DERIVED
    got: dict[str, None] = {}
    _needs(text, known, got)
    parts = ", ".join(f"{v} AS ({_render(known[v], _DUCK)})" for v in got)
    body = _render(text, _DUCK).strip()
    if not parts:
        return body
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {'RECURSIVE ' if m and m[1] else ''}{parts}, {body[m.end() :]}" if m else f"WITH {parts} {body}"
