"""Evaluation: metrics, pooled scores, ranks, best model, pivots (#23-#26, #33-#36, #38, #50, #51, #62)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Display names and display order of the eight estimators
# (must equal the reference's labels for the report tables).
MODEL_DISPLAY_NAMES = {
    "linear_regression": "Linear Regression",
    "ridge": "Ridge (L2)",
    "lasso": "Lasso (L1)",
    "elastic_net": "Elastic Net (L1+L2)",
    "decision_tree": "Decision Tree",
    "random_forest": "Random Forest",
    "xgboost": "XGBoost",
    "lightgbm": "LightGBM",
}
# Our naive, ML-free predictors (oracle-checkable predictions).
NAIVE_DISPLAY_NAMES = {
    "naive_lag1": "Naive (last week)",
    "naive_roll4": "Naive (4-week mean)",
    "naive_seasonal": "Naive (52 weeks ago)",
}
ALL_DISPLAY_NAMES = {**MODEL_DISPLAY_NAMES, **NAIVE_DISPLAY_NAMES}
MODEL_ORDER = {k: i for i, k in enumerate(ALL_DISPLAY_NAMES)}


def model_order_col(model_key: str = "model_key") -> F.Column:
    m = F.create_map(*[x for k, i in MODEL_ORDER.items() for x in (F.lit(k), F.lit(i))])
    return F.coalesce(m[F.col(model_key)], F.lit(len(MODEL_ORDER)))


def display_name_col(model_key: str = "model_key") -> F.Column:
    m = F.create_map(*[x for k, v in ALL_DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(model_key)], F.col(model_key))


def residuals(preds: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """#62: actual - predicted per period."""
    return preds.select("*", (F.col(actual) - F.col(predicted)).alias("residual"))


def metric_aggs(actual: str = "actual", predicted: str = "predicted") -> list:
    """MAE, RMSE, R^2 (scikit-learn convention: constant actuals -> 1 if perfect else 0).

    Only complete pairs are scored, and ``n`` counts those; ``missing_pairs`` tells what is left out.
    """
    p = F.col(predicted).cast("double")
    a = F.when(p.isNotNull(), F.col(actual).cast("double"))
    e = a - p
    ss_res = F.sum(e * e)
    ss_tot = F.var_pop(a) * F.count(a)
    r2 = (F.when(ss_tot > 0, F.lit(1.0) - F.try_divide(ss_res, ss_tot))
           .when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2")]


def forecast_metrics(preds: DataFrame, group_cols=("entity", "model_key"),
                     actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """#23: per (entity, model) metrics on the count scale (partial aggregation, one shuffle)."""
    return preds.groupBy(*group_cols).agg(*metric_aggs(actual, predicted))


def missing_pairs(preds: DataFrame, group_cols=("entity", "model_key"),
                  actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows per group without an actual or a predicted value, which the metrics leave out."""
    gap = F.col(actual).isNull() | F.col(predicted).isNull()
    return preds.groupBy(*group_cols).agg(F.count_if(gap).alias("n_missing"))


def combined_scores(preds: DataFrame, model_col: str = "model_key",
                    actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """#24 + #51: pool every entity's predictions per model (each period counts once), rank by MAE."""
    agg = preds.groupBy(model_col).agg(*metric_aggs(actual, predicted))
    w = Window.orderBy(F.col("mae"), model_order_col(model_col), F.col(model_col))
    return agg.select(F.row_number().over(w).alias("rank"),
                      display_name_col(model_col).alias("model"), model_col, "n", "mae", "rmse", "r2")


def metrics_table(metrics: DataFrame, tuned_keys=("decision_tree", "random_forest", "xgboost", "lightgbm"),
                  entity: str = "entity", extra=()) -> DataFrame:
    """#25: tidy (entity, model, model_key, mae, rmse, r2, tuned); ``tuned_keys``: the models that were tuned."""
    return metrics.select(F.col(entity).alias("entity"), display_name_col().alias("model"), "model_key",
                          "mae", "rmse", "r2", F.col("model_key").isin(list(tuned_keys)).alias("tuned"), *extra)


def rank_models(metrics: DataFrame, by: str = "mae", entity: str = "entity") -> DataFrame:
    """#50: unique ranks 1..m per entity; ascending for errors, descending for r2."""
    key = F.col(by).desc() if by == "r2" else F.col(by).asc()
    w = Window.partitionBy(entity).orderBy(key, model_order_col(), F.col("model_key"))
    return metrics.select("*", F.row_number().over(w).alias("rank"))


def best_model_per_entity(metrics: DataFrame, entity: str = "entity") -> DataFrame:
    """#26: argmin MAE per entity, first in model order on ties."""
    ranked = rank_models(metrics, "mae", entity)
    return ranked.filter(F.col("rank") == 1).drop("rank")


def model_comparison_pivot(metrics: DataFrame, entity: str = "entity") -> DataFrame:
    """#33: model x entity tables for mae / rmse / r2 stacked long by metric; a column for every entity of the data."""
    long = cut_lineage(metrics).select(entity, "model_key", F.stack(
        F.lit(3), F.lit("mae"), F.col("mae"), F.lit("rmse"), F.col("rmse"), F.lit("r2"), F.col("r2")
    ).alias("metric", "value"))
    return (long.groupBy("metric", "model_key").pivot(entity).agg(F.first("value")))


def signal_comparison(preds: DataFrame) -> DataFrame:
    """#34: (entity, signal, model) metrics for each feature signal."""
    return preds.groupBy("entity", "signal", "model_key").agg(*metric_aggs())


def signal_improvement(comparison: DataFrame, base: str, extended: str) -> DataFrame:
    """#35: mean RMSE per (entity, model) for both signals, improvement and % cut."""
    p = (comparison.groupBy("entity", "model_key").pivot("signal", [base, extended])
         .agg(F.avg("rmse")))
    imp = F.col(base) - F.col(extended)
    return p.select("entity", "model_key", F.col(base).alias("rmse_base"), F.col(extended).alias("rmse_extended"),
                    imp.alias("improvement"), (F.lit(100.0) * F.try_divide(imp, F.col(base))).alias("pct_cut"))


def signal_average(comparison: DataFrame, base: str, extended: str) -> DataFrame:
    """#36: mean RMSE per signal and the % lower error."""
    b = F.avg(F.when(F.col("signal") == base, F.col("rmse")))
    x = F.avg(F.when(F.col("signal") == extended, F.col("rmse")))
    return comparison.agg(b.alias("rmse_base"), x.alias("rmse_extended"),
                          (F.lit(100.0) * F.try_divide(b - x, b)).alias("pct_lower"))


def cv_scores(fold_preds: DataFrame, objective: str = "mae", group=("entity", "candidate")) -> DataFrame:
    """#38/#79: mean fold score per candidate (lower is better) and the best per entity.

    ``mae``: MAE on the modelling (log) scale; ``rmse``: RMSE after inverse
    transform inside each fold (columns ``actual_t``/``predicted_t`` are the
    log-scale values).
    """
    from ..functions import expm1_clip
    if objective == "rmse":
        e = expm1_clip("actual_t") - expm1_clip("predicted_t")
        per_fold = fold_preds.groupBy(*group, "fold").agg(F.sqrt(F.avg(e * e)).alias("score"))
    else:
        e = F.col("actual_t") - F.col("predicted_t")
        per_fold = fold_preds.groupBy(*group, "fold").agg(F.avg(F.abs(e)).alias("score"))
    scores = per_fold.groupBy(*group).agg(F.avg("score").alias("cv_score"), F.count("fold").alias("n_folds"))
    w = Window.partitionBy(group[0]).orderBy(F.col("cv_score"), F.col(group[1]))
    return scores.select("*", (F.row_number().over(w) == 1).alias("is_best"))
