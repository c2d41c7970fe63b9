"""Panels of one's own, merged moments, the density estimate and keys checked in the plan."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from weftcast.operators import eda as D
from weftcast.operators import joins as J
from weftcast.operators import models as MD
from weftcast.operators.accumulate import centred_moments
from weftcast.plans import modelling as ML
from weftcast.plans import runs as RN
from weftcast.sources import panels as P
from weftcast.spec import PanelSpec

LINEAR = ["linear_regression", "ridge"]


def moments_of(df, keys, cols):
    q = len(cols)
    out = {}
    for r in centred_moments(df, keys, cols).collect():
        m = np.array(r.moments)
        out[tuple(r[k] for k in keys)] = (m[0], m[1:q + 1], m[q + 1:].reshape(q, q))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_moments_of_a_far_mean_are_exact_on_any_layout(spark, partitions):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    x[:, 0] += 1e9
    x[:, 2] = 7.1
    rows = [(None if i % 3 == 0 else "a", *map(float, v)) for i, v in enumerate(x)] + [("a", None, 1.0, 1.0), ("empty", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "entity string, x double, y double, c double").repartition(partitions)
    out = moments_of(df, ["entity"], ["x", "y", "c"])
    assert set(out) == {(None,), ("a",)}  # a key without a whole row has no moments
    for key, part in (((None,), x[::3]), (("a",), x[np.arange(600) % 3 != 0])):
        n, mean, cross = out[key]
        centred = part - part.mean(axis=0)
        assert n == len(part)
        np.testing.assert_allclose(mean, part.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(cross[:2, :2], (centred.T @ centred)[:2, :2], rtol=1e-6, atol=1e-6)
        assert cross[2, 2] == 0 and not cross[2, :].any()  # a constant column has no spread at all


def test_linear_models_match_closed_forms_by_group(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for fold in (0, 1):
        for entity in ("a", "b"):
            x = rng.normal(size=(80, 2)) + [1e6, 0]
            y = x @ [0.5, -2.0] + rng.normal(size=80) + 3
            rows += [(fold, entity, *map(float, v), float(t)) for v, t in zip(x, y)]
            xc, yc = x - x.mean(axis=0), y - y.mean()
            want[fold, entity] = (np.linalg.lstsq(xc, yc, rcond=None)[0], np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc), x.mean(axis=0), y.mean())
    df = spark.createDataFrame(rows, "fold int, entity string, u double, v double, y double").repartition(7)
    out = MD.fit_linear_family(df, "entity", ["u", "v"], "y", LINEAR, group_cols=("fold",))
    assert out.schema["fold"].dataType.typeName() == "integer"
    found = {(r.fold, r.entity, r.model_key): (r.intercept, r.coef) for r in out.collect()}
    assert len(found) == 8
    for (fold, entity), (ols, ridge, xm, ym) in want.items():
        for key, w in (("linear_regression", ols), ("ridge", ridge)):
            b, coef = found[fold, entity, key]
            np.testing.assert_allclose(coef, w, rtol=1e-7)
            np.testing.assert_allclose(b, ym - xm @ w, rtol=1e-6)


def test_density_estimate_against_numpy(spark):
    rng = np.random.default_rng(9)
    res = rng.normal(size=5000)
    rows = [("a", "m", 0.0, float(-v)) for v in res] + [("a", "one", 1.0, 0.0), ("a", "m", None, 1.0), (None, "m", 1.0, 0.0), (None, "m", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "entity string, model_key string, actual double, predicted double").repartition(6)
    out = D.residual_kde(df, 50)
    assert "Join" not in str(out._jdf.queryExecution().optimizedPlan().toString()).split("MapInArrow")[0]
    rows = out.collect()
    got = {(r.entity, r.model_key, r.grid_idx): r for r in rows}
    assert len(rows) == len(got) == 150
    h = len(res) ** -0.2 * res.std(ddof=1)
    for i in (0, 17, 49):
        x = res.min() + (res.max() - res.min()) * i / 49
        want = np.exp(-0.5 * ((x - res) / h) ** 2).sum() / (len(res) * h * np.sqrt(2 * np.pi))
        assert got["a", "m", i].x == pytest.approx(x) and got["a", "m", i].density == pytest.approx(want)
    assert all(got["a", "one", i].density is None for i in range(50))
    assert got[None, "m", 0].density is not None


def test_keys_are_checked_in_the_plan(spark):
    left = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 3.0)], "entity string, week int, x double")
    right = spark.createDataFrame([("a", 1, 10), (None, 1, 30)], "entity string, week int, y int")
    got = {(r.entity, r.week): r.y for r in J.join_labels(left, right, ["entity", "week"], validate="plan").collect()}
    assert got == {("a", 1): 10, ("a", 2): None, (None, 1): 30}
    for a, b, side in ((left.union(left.limit(1)), right, "left"), (left, right.union(right.limit(1)), "right")):
        joined = J.join_labels(a, b, ["entity", "week"], validate="plan")  # nothing runs yet
        with pytest.raises(Exception, match=f"not unique in {side}"):
            joined.select("x").collect()


def renamed_panel(spark):
    spec = PanelSpec(entity="shop", period="week_start", target="sold", split="part", extra_keys=("yr", "wk"))
    names = {"entity": "shop", "period": "week_start", "year": "yr", "weekofyear": "wk"}
    features = P.panel_features(spark, SF_SMALL).withColumnsRenamed(names)
    labels = P.panel_labels(spark, SF_SMALL).withColumnsRenamed(names).withColumnRenamed("target", "sold")
    note = F.lit("text is no predictor").alias("note")
    train = features.where("split = 'train'").drop("split").select("*", note, F.col("week_start").cast("string").alias("w")).drop("week_start").withColumnRenamed("w", "week_start")
    return P.read_panel(train, labels, features.where("split = 'test'").drop("split"), spec), spec


@pytest.mark.parametrize("autoregressive", [False, True])
def test_a_run_on_a_panel_of_other_names_equals_that_on_the_tables(spark, autoregressive):
    panel, spec = renamed_panel(spark)
    cfg = ML.RunConfig(k=6)
    own = RN.run_panel(panel, spec, autoregressive, LINEAR, cfg, tune=(), redundant=("f_price_dup",))
    known = RN.run_forecast(spark, SF_SMALL, autoregressive, LINEAR, cfg, tune=())
    keys = ["entity", "model_key", "period"]
    a, b = ({tuple(r[k] for k in keys): r.predicted for r in x.predictions.collect()} for x in (own, known))
    assert a and set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)
    a, b = ({(r.entity, r.period): r.total_cases for r in x.submission.collect()} for x in (own, known))
    assert a and a == b


def test_year_and_week_come_from_the_period_without_extra_keys(spark):
    df = spark.createDataFrame([(7, dt.date(2021, 1, 3), 1, 2.0, float("nan"), "train")], "e long, d date, y int, x double, z double, s string")
    row = P.standard_panel(df, PanelSpec(entity="e", period="d", target="y", split="s")).first()
    assert (row.entity, row.year, row.weekofyear, row.x, row.z) == ("7", 2020, 53, 2.0, None)
