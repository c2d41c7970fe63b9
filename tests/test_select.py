"""Exact grid k-NN radius and KSG mutual information vs a NumPy brute force."""

import numpy as np
from pyspark.sql import functions as F

from scipy_free_digamma import digamma_int
from weftcast.operators import select as SEL


def _frame(spark, n=150, seed=0, dup=False):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(size=n)
    y = 0.8 * x1 + rng.normal(scale=0.6, size=n)
    x2 = np.round(rng.normal(size=n), 1) if dup else rng.normal(size=n)   # many ties
    rows = [("e", i, float(a), float(b), float(t)) for i, (a, b, t) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "entity string, period int, x1 double, x2 double, y double")


def _brute(pts, k=3):
    out = {}
    for (feat,), g in pts.groupby(["feature"]):
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        n = len(x)
        d = np.maximum(np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :]))
        np.fill_diagonal(d, np.inf)
        eps = np.sort(d, axis=1)[:, k - 1]
        e = eps * SEL.EPS_SHRINK
        nx = (x[None, :] < (x + e)[:, None]).sum(1) - (x[None, :] <= (x - e)[:, None]).sum(1) - 1
        ny = (y[None, :] < (y + e)[:, None]).sum(1) - (y[None, :] <= (y - e)[:, None]).sum(1) - 1
        mi = digamma_int(n) + digamma_int(k) - np.mean([digamma_int(v + 1) for v in nx]) \
            - np.mean([digamma_int(v + 1) for v in ny])
        out[feat] = (dict(zip(g["rid"], eps)), max(mi, 0.0))
    return out


def test_grid_knn_and_mi_equal_brute_force(spark):
    for dup in (False, True):
        df = _frame(spark, dup=dup)
        pts = SEL.mi_points(df, "entity", "period", "y", ["x1", "x2"])
        pdf = pts.toPandas()
        exp = _brute(pdf)
        eps = SEL.knn_radius(pts, "entity", 3).toPandas()
        for feat, g in eps.groupby("feature"):
            ref = exp[feat][0]
            assert len(g) == len(ref)
            assert all(abs(r.eps - ref[r.rid]) < 1e-15 for r in g.itertuples())
        mi = {r["feature"]: r["mi"] for r in SEL.mutual_info_ksg(df, "entity", "period", "y", ["x1", "x2"]).collect()}
        for feat in ("x1", "x2"):
            assert abs(mi[feat] - exp[feat][1]) < 1e-9
        assert mi["x1"] > mi["x2"]


def test_select_top_k_prefers_later_column_on_ties(spark):
    rows = [("e", "a", 0, 0.5), ("e", "b", 1, 0.5), ("e", "c", 2, 0.1)]
    s = spark.createDataFrame(rows, "entity string, feature string, feature_idx int, mi double")
    sel = {r["feature"]: r for r in SEL.select_top_k(s, "entity", 1).collect()}
    assert sel["b"]["selected"] and not sel["a"]["selected"] and sel["b"]["sel_order"] == 1
    assert SEL.select_top_k(s, "entity", 5).filter(F.col("selected")).count() == 3
