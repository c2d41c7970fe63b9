"""A slice of the oracle gate: Spark queries vs their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = ["flagship", "scan_panel", "engineered_features", "case_lags", "timeseries_cv_folds",
         "combined_scores", "correlation_matrix", "target_histogram", "scale_features", "missing_summary"]


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
    if hasattr(v, "item") and not hasattr(v, "isoformat"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        s = str(v)[:19]
        return s[:10] if s.endswith("00:00:00") else s
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(repr(_norm(x)) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(E.oracle_sql()[name]).fetchdf()
    assert _rows(sp) == _rows(dk)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["entity", "model_key", "n", "mae", "rmse", "r2"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
