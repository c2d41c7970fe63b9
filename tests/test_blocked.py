"""Blocked (halo) windows equal the plain entity windows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from weftcast.operators import blocked as B
from weftcast.operators import clean as C
from weftcast.operators import features as FE
from weftcast.spec import PanelSpec

SPEC = PanelSpec(entity="entity", period="period", target="target", split="split")


def _panel(spark, n=150, null_frac=0.4, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for e, start in (("a", 0), ("b", 3)):
        for i in range(n):
            x = float(rng.normal(5, 2)) if rng.random() > null_frac else None
            rows.append((e, dt.date(1999, 1, 4) + dt.timedelta(weeks=start + i), x, 1,
                         "train" if i < n - 30 else "test"))
    return spark.createDataFrame(rows, "entity string, period date, x double, target long, split string")


def _same(a, b, cols):
    a = a.select(*cols).toPandas().sort_values(["entity", "period"]).reset_index(drop=True)
    b = b.select(*cols).toPandas().sort_values(["entity", "period"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in cols[2:]:
        x, y = a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(x), np.isnan(y)), c
        assert np.allclose(x[~np.isnan(x)], y[~np.isnan(y)], rtol=1e-12, atol=1e-12), c


def test_row_positions_are_dense(spark):
    df = B.row_positions(_panel(spark), SPEC, bucket_days=70)
    w = df.groupBy("entity").agg(F.min(B.POS).alias("lo"), F.max(B.POS).alias("hi"),
                                 F.countDistinct(B.POS).alias("n")).collect()
    assert all(r["lo"] == 0 and r["hi"] == 149 and r["n"] == 150 for r in w)


def test_blocked_windows_equal_plain(spark):
    df = C.impute_ffill_bfill(_panel(spark, null_frac=0.2), SPEC, ["x"])
    plain = FE.window_features(df, SPEC, ["x"])
    blocked = B.blocked_window_features(df, SPEC, ["x"], block_rows=16)
    cols = ["entity", "period"] + [c for c in plain.columns if c.startswith("x_")]
    _same(plain, blocked, cols)


def test_blocked_ffill_bfill_equals_plain(spark):
    df = _panel(spark, null_frac=0.6)
    _same(C.impute_ffill_bfill(df, SPEC, ["x"]), B.blocked_ffill_bfill(df, SPEC, ["x"], block_rows=8),
          ["entity", "period", "x"])


def test_engineer_blocked_equals_plain(spark):
    df = C.impute_ffill_bfill(_panel(spark, null_frac=0.3), SPEC, ["x"])
    a, names, _ = FE.engineer(df, SPEC, seasonality=False)
    b, names_b, _ = FE.engineer(df, SPEC, seasonality=False, block_rows=20)
    assert names == names_b
    _same(a, b, ["entity", "period", *names])
