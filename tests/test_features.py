"""Causal features, imputation, temporal split and CV folds."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftcast.operators import clean as C
from weftcast.operators import features as FE
from weftcast.operators import split as S
from weftcast.spec import PanelSpec

SPEC = PanelSpec(entity="entity", period="period", target="target", split="split")


def _panel(spark, n=40, seed=0, null_frac=0.3):
    rng = np.random.default_rng(seed)
    rows = []
    for e in ("a", "b"):
        for i in range(n):
            x = float(rng.normal(10, 3)) if rng.random() > null_frac else None
            rows.append((e, dt.date(2000, 1, 3) + dt.timedelta(weeks=i), x, int(rng.poisson(8)),
                         "train" if i < n - 8 else "test"))
    return spark.createDataFrame(rows, "entity string, period date, x double, target long, split string")


def _pandas_reference(pdf):
    """pandas semantics of the reference: shift / rolling on the row order."""
    out = []
    for _, g in pdf.sort_values("period").groupby("entity"):
        g = g.copy()
        s = g["x"]
        for k in (1, 4):
            g[f"x_lag_{k}"] = s.shift(k)
        for w in (4, 8, 12):
            r = s.shift(1).rolling(window=w, min_periods=max(2, w // 2))
            g[f"x_rollmean_{w}"] = r.mean()
            g[f"x_rollstd_{w}"] = r.std()
        out.append(g)
    return pd.concat(out)


def test_lags_and_rolling_match_pandas(spark):
    df = _panel(spark)
    got = FE.window_features(df, SPEC, ["x"], lags=(1, 4)).toPandas().sort_values(["entity", "period"])
    exp = _pandas_reference(df.toPandas()).sort_values(["entity", "period"])
    for c in [c for c in exp.columns if c.startswith("x_")]:
        a, b = got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-9, atol=1e-9), c


def test_ffill_bfill_matches_pandas_per_split(spark):
    df = _panel(spark, seed=3, null_frac=0.5)
    got = C.impute_ffill_bfill(df, SPEC, ["x"]).toPandas().sort_values(["entity", "period"])
    pdf = df.toPandas().sort_values(["entity", "period"])
    pdf["x"] = pdf.groupby(["entity", "split"])["x"].transform(lambda s: s.ffill().bfill())
    assert np.allclose(got["x"].to_numpy(dtype=float), pdf["x"].to_numpy(dtype=float), equal_nan=True)


def test_features_are_causal(spark):
    """Changing rows after period t never changes lag / rolling features at <= t."""
    df = _panel(spark, seed=5, null_frac=0.0)
    cut = dt.date(2000, 1, 3) + dt.timedelta(weeks=20)
    changed = df.withColumn("x", F.when(F.col("period") > F.lit(cut), F.col("x") * 100).otherwise(F.col("x")))
    cols = ["entity", "period"] + [f"x_lag_{k}" for k in (1, 2, 3, 4)] + \
        [f"x_roll{s}_{w}" for w in (4, 8, 12) for s in ("mean", "std")]
    a = FE.window_features(df, SPEC, ["x"]).filter(F.col("period") <= F.lit(cut)).select(*cols)
    b = FE.window_features(changed, SPEC, ["x"]).filter(F.col("period") <= F.lit(cut)).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_drop_undefined_keeps_all_test_rows(spark):
    df = _panel(spark, null_frac=0.0)
    eng, names, _ = FE.engineer(df, SPEC, seasonality=False)
    counts = {r["split"]: r["count"] for r in eng.groupBy("split").count().collect()}
    assert counts["test"] == 16                 # every test week kept
    assert counts["train"] == 2 * (32 - 6)      # roll-12 needs 6 prior rows
    assert eng.filter(F.col("split") == "train").dropna(subset=names).count() == counts["train"]


def test_temporal_split_counts_and_order(spark):
    rows = [("sj", dt.date(1990, 1, 1) + dt.timedelta(weeks=i), "train") for i in range(930)] + \
           [("iq", dt.date(2000, 1, 1) + dt.timedelta(weeks=i), "train") for i in range(514)]
    df = spark.createDataFrame(rows, "entity string, period date, split string")
    s = S.temporal_split(df, SPEC)
    c = {(r["entity"], r["role"]): r["count"] for r in s.groupBy("entity", "role").count().collect()}
    assert c == {("sj", "fit"): 697, ("sj", "holdout"): 233, ("iq", "fit"): 385, ("iq", "holdout"): 129}
    bounds = s.groupBy("entity", "role").agg(F.min("period").alias("lo"), F.max("period").alias("hi")).collect()
    b = {(r["entity"], r["role"]): r for r in bounds}
    for e in ("sj", "iq"):
        assert b[(e, "fit")]["hi"] < b[(e, "holdout")]["lo"]


def test_timeseries_folds_match_expanding_split(spark):
    for n, t, trains in ((697, 139, [141, 280, 419, 558]), (385, 77, [77, 154, 231, 308])):
        rows = [("e", dt.date(1990, 1, 1) + dt.timedelta(weeks=i)) for i in range(n)]
        df = spark.createDataFrame(rows, "entity string, period date")
        f = S.timeseries_cv_folds(df, SPEC, 4)
        c = {(r["fold"], r["cv_role"]): r["count"] for r in f.groupBy("fold", "cv_role").count().collect()}
        assert [c[(i, "train")] for i in range(4)] == trains
        assert all(c[(i, "valid")] == t for i in range(4))


def test_case_features_after_drop(spark):
    df = _panel(spark, null_frac=0.0)
    eng, names, case = FE.engineer(df, SPEC, seasonality=False, autoregressive=True)
    assert case == ["cases_lag_1", "cases_lag_2", "cases_lag_3", "cases_lag_4", "cases_rollmean_4"]
    tr = eng.filter(F.col("split") == "train")
    assert tr.count() == 2 * (32 - 6 - 4)
    assert tr.dropna(subset=case).count() == tr.count()
    te = eng.filter(F.col("split") == "test")
    assert te.filter(F.coalesce(*[F.col(c) for c in case]).isNotNull()).count() == 0
