"""Sessions whose calls all lack a result, as a session with fewer than two views has: SQL counts no good and bad ones there, but gives null."""

import duckdb
import pandas as pd
import pytest
from test_queries import canon

from tracelake.plans import catalog

KINDS = {0: "click view view view click purchase", 1: "click click purchase", 2: "click view", 3: "click", 4: "view view signup", 5: "click view view error click view view"}


@pytest.mark.parametrize("users", [(0, 1, 2, 3, 4, 5), (1, 2, 3)])
@pytest.mark.parametrize("name", ["agent_rollup", "agent_waste", "skill_calls", "session_totals"])
def test_all_calls_open(spark, tmp_path, users, name):
    rows = [(u, kind) for u in users for kind in KINDS[u].split()]
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {i} SECOND, {u}, '{kind}', {i}.5, '{{\"k\": {i}}}')" for i, (u, kind) in enumerate(rows))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT CAST(a AS BIGINT) AS event_id, t AS ts, CAST(u AS BIGINT) AS user_id, e AS event_type, CAST(v AS DOUBLE) AS value, p AS props FROM (VALUES {values}) x(a, t, u, e, v, p)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = canon(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), canon(con.execute(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_column_type=False)
