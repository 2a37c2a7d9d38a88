"""Every training-data query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tracelake.llm import registry

DATA = "/root/testdata/sf0.001"


def canon(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pdf[c].map(lambda v: "-" if v is None or v is pd.NA or v != v else f"{v:.9f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v))
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = canon(registry.QUERIES[name](spark, DATA).toPandas()), canon(con.execute(registry.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_column_type=False)
