"""Flagship slice and the ML-free predictions that feed the evaluation tables.

impute -> lag/rolling -> drop undefined -> 75 % temporal split -> naive
predictors -> metrics.  Every step is a Catalyst window/aggregate over one
entity-partitioned panel: a single shuffle builds the panel from orders, one
exchange by entity serves all windows, and the metrics are a partial
aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import r6
from ..operators.clean import drop_redundant, impute_ffill_bfill
from ..operators.features import drop_undefined_lags, engineer, lag_exprs, rolling_exprs
from ..operators.metrics import forecast_metrics
from ..operators.split import temporal_split
from ..sources.panels import PANEL_SPEC, REDUNDANT_COLUMNS, weekly_panel

SPEC = PANEL_SPEC
KEYS = ["entity", "period", "year", "weekofyear"]


def cleaned_panel(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    """Raw weekly panel -> redundant column dropped -> ffill/bfill per (entity, split)."""
    p = drop_redundant(weekly_panel(spark, sf_dir), REDUNDANT_COLUMNS)
    if cols is not None:
        p = p.select(*KEYS, *cols, "target", "split")
    return impute_ffill_bfill(p.repartition("entity"), SPEC)


def flagship_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f_urgent imputed -> lag 4, rolling-12 mean/std -> undefined train rows dropped."""
    p = cleaned_panel(spark, sf_dir, ["f_urgent"])
    w = Window.partitionBy("entity").orderBy("period")
    p = p.select("*", *lag_exprs("f_urgent", [4], w), *rolling_exprs("f_urgent", [12], w))
    feats = ["f_urgent", "f_urgent_lag_4", "f_urgent_rollmean_12", "f_urgent_rollstd_12"]
    return drop_undefined_lags(p, SPEC, feats)


def holdout_frame(features: DataFrame, train_frac: float = 0.75) -> DataFrame:
    """Train rows with a 'fit'/'holdout' role from the per-entity 75 % split."""
    return temporal_split(features.filter(F.col("split") == "train"), SPEC, train_frac)


def naive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out predictions of three ML-free models (entity, model_key, period, actual, predicted).

    naive_lag1: last week's count; naive_roll4: mean of the 4 previous weeks
    (>= 2 known); naive_seasonal: the count 52 rows earlier (rows without one
    are dropped).
    """
    tr = holdout_frame(flagship_features(spark, sf_dir))
    w = Window.partitionBy("entity").orderBy("period")
    y = F.col("target").cast("double")
    f4 = w.rowsBetween(-4, -1)
    tr = tr.select("entity", "period", "role", y.alias("actual"),
                   F.lag(y, 1).over(w).alias("naive_lag1"),
                   F.when(F.count(y).over(f4) >= 2, F.avg(y).over(f4)).alias("naive_roll4"),
                   F.lag(y, 52).over(w).alias("naive_seasonal"))
    long = tr.filter(F.col("role") == "holdout").select(
        "entity", "period", "actual",
        F.stack(F.lit(3), F.lit("naive_lag1"), F.col("naive_lag1"), F.lit("naive_roll4"), F.col("naive_roll4"),
                F.lit("naive_seasonal"), F.col("naive_seasonal")).alias("model_key", "predicted"))
    return long.filter(F.col("predicted").isNotNull()).select("entity", "model_key", "period", "actual", "predicted")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry(): naive lag-1 hold-out metrics per entity for the f_urgent slice."""
    tr = holdout_frame(flagship_features(spark, sf_dir))
    w = Window.partitionBy("entity").orderBy("period")
    preds = tr.select("entity", "role", F.col("target").cast("double").alias("actual"),
                      F.lag(F.col("target").cast("double"), 1).over(w).alias("predicted"))
    preds = preds.filter(F.col("role") == "holdout").withColumn("model_key", F.lit("naive_lag1"))
    m = forecast_metrics(preds)
    return m.select("entity", "model_key", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"),
                    r6("r2").alias("r2"))


def engineered_panel(spark: SparkSession, sf_dir: str, autoregressive: bool = False):
    """Full reference feature build on the weekly panel: (frame, feature names, case names)."""
    return engineer(cleaned_panel(spark, sf_dir), SPEC, autoregressive=autoregressive)


def engineered(panel: DataFrame, autoregressive: bool = False):
    """The same build on any panel with the column names of ``SPEC`` (``sources.panels.standard_panel``)."""
    return engineer(impute_ffill_bfill(panel.repartition("entity"), SPEC), SPEC, autoregressive=autoregressive)
