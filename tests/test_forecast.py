"""Recursive (autoregressive) forecast: the Catalyst array fold equals a sequential loop."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from weftcast.operators import models as MD
from weftcast.plans import runs as RN


def test_recursive_linear_fold_equals_python_loop(spark):
    full = RN.stack_for(spark, SF_SMALL, autoregressive=True, full_train=True)
    fr = full.frame
    coefs = MD.fit_linear_family(fr.filter(F.col("role") == "fit"), "entity", full.slots, "y_t", ["ridge"])
    got = {(r["entity"], r["period"]): r["predicted"]
           for r in RN.ML.forecast_recursive_linear(full, coefs).collect()}
    co = {r["entity"]: (r["intercept"], np.array(r["coef"])) for r in coefs.collect()}
    st = {r["entity"]: r.asDict() for r in full.scaler.collect()}
    case = full.case_names
    checked = 0
    for e in co:
        hist = [float(r["target"]) for r in fr.filter((F.col("entity") == e) & (F.col("split") == "train"))
                .orderBy("period").select("target").collect()]
        rows = fr.filter((F.col("entity") == e) & (F.col("role") == "test")).orderBy("period").collect()
        b, w = co[e]
        for r in rows:
            vals = {f"cases_lag_{k}": hist[-k] for k in (1, 2, 3, 4)}
            vals["cases_rollmean_4"] = float(np.mean(hist[-4:]))
            x = []
            for j, s in enumerate(full.slots):
                name = r["sel_names"][j]
                if name in case:
                    x.append((vals[name] - st[e][f"{s}__mean"]) / st[e][f"{s}__scale"])
                else:
                    x.append(r[s] if r[s] is not None else 0.0)
            pred = max(np.expm1(b + float(np.dot(w, x))), 0.0)
            assert abs(got[(e, r["period"])] - pred) <= 1e-9 * max(1.0, abs(pred))
            hist.append(pred)
            checked += 1
    assert checked > 0
