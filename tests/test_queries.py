"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from groveframe.plans import registry

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = df[c].astype(float)
        except (TypeError, ValueError):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(registry.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(registry.ORACLE_SQL[name]).df())
    assert len(got) > 0
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=0, rtol=0)


@pytest.mark.parametrize("name", ["JN1", "JN2", "JN4", "JN7", "JN8", "JN10"])
def test_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
