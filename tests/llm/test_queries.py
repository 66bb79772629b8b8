"""Queries of the subpackage against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pagewright.llm import queries

SF = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].round(6) if str(df[c].dtype).startswith("float") else df[c].map(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)
