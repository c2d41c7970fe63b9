"""Metrics, ranking and pooled scoring (the reference's evaluation tests, on Spark)."""

import math

from pyspark.sql import functions as F

from weftcast.operators import metrics as M


def _preds(spark, rows):
    return spark.createDataFrame(rows, "entity string, model_key string, period int, actual double, predicted double")


def test_perfect_prediction_metrics(spark):
    df = _preds(spark, [("a", "m", i, float(v), float(v)) for i, v in enumerate([1, 2, 3, 4])])
    r = M.forecast_metrics(df).first()
    assert r["mae"] == 0.0 and r["rmse"] == 0.0 and r["r2"] == 1.0


def test_known_metric_values(spark):
    df = _preds(spark, [("a", "m", 0, 0.0, 1.0), ("a", "m", 1, 0.0, -1.0), ("a", "m", 2, 10.0, 7.0)])
    r = M.forecast_metrics(df).first()
    assert math.isclose(r["mae"], 5 / 3)
    assert math.isclose(r["rmse"], math.sqrt(11 / 3))


def test_constant_actuals_r2_follows_sklearn(spark):
    df = _preds(spark, [("a", "m", i, 3.0, 3.0 + (i % 2)) for i in range(4)])
    assert M.forecast_metrics(df).first()["r2"] == 0.0


def _offset_rows(entity, key, off, n=10):
    return [(entity, key, i, float(i), float(i) + off) for i in range(n)]


def test_rank_orders_best_first_per_entity(spark):
    rows = _offset_rows("iq", "a", 9.0) + _offset_rows("iq", "b", 3.0) + _offset_rows("iq", "c", 6.0)
    ranked = M.rank_models(M.forecast_metrics(_preds(spark, rows)), "mae").orderBy("rank").collect()
    assert [r["mae"] for r in ranked] == [3.0, 6.0, 9.0]
    assert ranked[0]["model_key"] == "b" and [r["rank"] for r in ranked] == [1, 2, 3]


def test_rank_is_unique_on_ties(spark):
    rows = _offset_rows("iq", "ridge", 2.0) + _offset_rows("iq", "lasso", 2.0)
    ranks = sorted(r["rank"] for r in M.rank_models(M.forecast_metrics(_preds(spark, rows)), "mae").collect())
    assert ranks == [1, 2]


def test_combined_scores_pool_every_period_once(spark):
    rows = (_offset_rows("sj", "a", 4.0) + _offset_rows("iq", "a", 2.0)
            + _offset_rows("sj", "b", 8.0) + _offset_rows("iq", "b", 6.0))
    comb = M.combined_scores(_preds(spark, rows)).orderBy("rank").collect()
    assert [r["model_key"] for r in comb] == ["a", "b"]
    assert comb[0]["rank"] == 1 and comb[0]["mae"] == 3.0 and comb[1]["mae"] == 7.0
    assert comb[0]["n"] == 20


def test_best_model_first_in_model_order_on_ties(spark):
    rows = _offset_rows("sj", "lasso", 2.0) + _offset_rows("sj", "ridge", 2.0)
    best = M.best_model_per_entity(M.forecast_metrics(_preds(spark, rows))).collect()
    assert len(best) == 1 and best[0]["model_key"] == "ridge"


def test_metrics_table_display_names_and_tuned(spark):
    rows = _offset_rows("sj", "elastic_net", 1.0) + _offset_rows("sj", "xgboost", 1.0)
    t = {r["model_key"]: r for r in M.metrics_table(M.forecast_metrics(_preds(spark, rows))).collect()}
    assert t["elastic_net"]["model"] == "Elastic Net (L1+L2)" and not t["elastic_net"]["tuned"]
    assert t["xgboost"]["model"] == "XGBoost" and t["xgboost"]["tuned"]


def test_cv_scores_pick_lowest_mean(spark):
    rows = [("e", "c1", f, i, 1.0, 1.5) for f in range(2) for i in range(3)] + \
           [("e", "c2", f, i, 1.0, 1.1) for f in range(2) for i in range(3)]
    df = spark.createDataFrame(rows, "entity string, candidate string, fold int, period int, actual_t double, "
                                     "predicted_t double")
    best = M.cv_scores(df).filter(F.col("is_best")).first()
    assert best["candidate"] == "c2" and abs(best["cv_score"] - 0.1) < 1e-12
