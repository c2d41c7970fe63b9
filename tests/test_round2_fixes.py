"""Round-trip and edge cases of outputs, metrics and the recursion."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from weftcast.operators import metrics as M
from weftcast.plans import modelling as ML
from weftcast.plans import runs as RN

PREDS = "entity string, model_key string, period date, actual double, predicted double"


def test_partition_names_come_back(spark, tmp_path):
    day = dt.date(2000, 1, 3)
    names = ["NORTH WEST", "A:B", "x/y=z", "plain"]
    preds = spark.createDataFrame([(n, "ridge", day, 1.0, 2.0) for n in names], PREDS)
    back = RN.scan_holdout_predictions(spark, RN.write_predictions(preds, str(tmp_path)))
    assert sorted((r.entity, r.model_key, r.week_start_date, r.actual, r.predicted) for r in back.collect()) == sorted((n, "ridge", day, 1.0, 2.0) for n in names)


def test_only_complete_pairs_are_scored(spark):
    day = dt.date(2000, 1, 3)
    preds = spark.createDataFrame([("a", "m", day, 1.0, 2.0), ("a", "m", day, 3.0, 2.0), ("a", "m", day, 100.0, None), ("a", "m", day, None, 5.0)], PREDS)
    r = M.forecast_metrics(preds).first()
    assert (r.n, r.mae, r.rmse, r.r2) == (2, 1.0, 1.0, 0.0)
    assert M.missing_pairs(preds).first().n_missing == 2


def test_tuned_is_what_was_tuned(spark):
    scored = spark.createDataFrame([("a", "xgboost", 5, 1.0, 1.0, 0.5)], "entity string, model_key string, n int, mae double, rmse double, r2 double")
    assert M.metrics_table(scored).first().tuned
    plain = M.metrics_table(scored, (), extra=("n",)).first()
    assert not plain.tuned and plain.n == 5


def test_case_values_follow_their_names():
    parts = ML.case_parts(["cases_lag_2", "cases_rollmean_6"])
    past = np.array([1.0, 2.0, 4.0])
    assert ML.case_value(past, *parts["cases_lag_2"]) == 2.0
    assert math.isclose(ML.case_value(past, *parts["cases_rollmean_6"]), 7 / 3)
    assert math.isnan(ML.case_value(past[:1], "lag", 2)) and math.isnan(ML.case_value(past[:1], "rollmean", 6))
    with pytest.raises(ValueError):
        ML.case_parts(["cases_std_3"])
