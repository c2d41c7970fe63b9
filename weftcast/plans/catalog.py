"""Query catalog: one Spark callable (and, where SQL can express it, one oracle SQL) per
operator of the inventory.  ``__spark_entry__`` exposes these dictionaries.

Every query reads the driver tables (or panels Spark derives from them) in
full; nothing is sampled or capped.  Double columns are rounded on both sides
(9 significant digits, see ``functions.r6``) so the order-insensitive value
hash is engine-independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import expm1_clip, log1p_target, r6, rint_long
from ..operators import clean as C
from ..operators import features as FE
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import split as S
from ..sources import panels as P
from ..session import cut_lineage
from ..spec import feature_columns, numeric_columns
from . import flagship as FL
from . import sqlparts as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPEC = P.PANEL_SPEC
#: The five segments of the driver tables, for the oracle SQL alone; queries take their columns from the data.
ENTITIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NAIVE_KEYS = list(M.NAIVE_DISPLAY_NAMES)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def sel_sql(cols_double: list[str], cols_other: list[str], src: str, where: str = "") -> str:
    parts = cols_other + [f"{Q.r6(c)} AS {c}" for c in cols_double]
    return f"SELECT {', '.join(parts)} FROM {src} {where}"


# --------------------------------------------------------------------------- #
# 2.1 / 2.2 / 2.3 scans, projections, joins
# --------------------------------------------------------------------------- #
PANEL_COLS = ["entity", "period", "year", "weekofyear", "target", "split"]
RAW_F = ["f_price", "f_urgent", "f_acct", "f_price_dup"]


@query("scan_panel", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(RAW_F, PANEL_COLS, "weekly_panel")))
def q_scan_panel(spark, sf):
    """#1: features of both splits with labels attached (NULL target on test)."""
    return P.scan_panel(spark, sf)


@query("drop_redundant", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(Q.BASE3, PANEL_COLS, "weekly_panel")))
def q_drop_redundant(spark, sf):
    """#9: the configured duplicate predictor removed."""
    return C.drop_redundant(P.scan_panel(spark, sf), P.REDUNDANT_COLUMNS)


@query("prepare_dates", Q.with_ctes(*Q.PANEL_CTES, body=(
    "SELECT entity, period, split, CAST(row_number() OVER (PARTITION BY entity ORDER BY period) AS INTEGER) AS period_index "
    "FROM weekly_panel")))
def q_prepare_dates(spark, sf):
    """#10: date-typed period and its order within the entity."""
    p = P.scan_panel(spark, sf)
    w = Window.partitionBy("entity").orderBy("period")
    return p.select("entity", F.to_date("period").alias("period"), "split",
                    F.row_number().over(w).alias("period_index"))


@query("split_by_entity", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(
    RAW_F, PANEL_COLS, "weekly_panel", "WHERE entity IN ('AUTOMOBILE', 'MACHINERY')")))
def q_split_by_entity(spark, sf):
    """#11: keep the configured entities."""
    return C.split_by_entity(P.scan_panel(spark, sf), SPEC, ["AUTOMOBILE", "MACHINERY"])


@query("read_panel", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(RAW_F, PANEL_COLS, "weekly_panel")))
def q_read_panel(spark, sf):
    """#1, #15: the panel of train features, their labels and test features, as three sources with keys checked in the plan."""
    features, labels = P.panel_features(spark, sf), P.panel_labels(spark, sf)
    return P.read_panel(features.where("split = 'train'"), labels, features.where("split = 'test'"))


@query("join_labels", Q.with_ctes(*Q.PANEL_CTES, body=(
    "SELECT f.entity, f.year, f.weekofyear, f.period, f.split, l.target FROM "
    "(SELECT entity, year, weekofyear, period, split FROM weekly_panel) f LEFT JOIN "
    "(SELECT entity, year, weekofyear, target FROM weekly_panel WHERE split = 'train') l "
    "ON f.entity = l.entity AND f.year = l.year AND f.weekofyear = l.weekofyear")))
def q_join_labels(spark, sf):
    """#15: validated one-to-one left join of feature rows to labels."""
    feats = P.panel_features(spark, sf).select("entity", "year", "weekofyear", "period", "split")
    labels = P.panel_labels(spark, sf)
    return J.join_labels(feats, labels, ["entity", "year", "weekofyear"], validate="plan")


@query("join_key_violations", Q.with_ctes(*Q.PANEL_CTES, body=(
    "SELECT 'duplicate_feature_key' AS violation, entity, year, weekofyear, count(*) AS n FROM weekly_panel "
    "GROUP BY entity, year, weekofyear HAVING count(*) > 1 "
    "UNION ALL SELECT 'duplicate_label_key', entity, year, weekofyear, count(*) FROM weekly_panel WHERE split = 'train' "
    "GROUP BY entity, year, weekofyear HAVING count(*) > 1 "
    "UNION ALL SELECT 'unlabelled_feature_row', f.entity, f.year, f.weekofyear, count(*) FROM weekly_panel f "
    "WHERE NOT EXISTS (SELECT 1 FROM weekly_panel l WHERE l.split = 'train' AND l.entity IS NOT DISTINCT FROM f.entity "
    "AND l.year IS NOT DISTINCT FROM f.year AND l.weekofyear IS NOT DISTINCT FROM f.weekofyear) "
    "GROUP BY f.entity, f.year, f.weekofyear")))
def q_join_key_violations(spark, sf):
    """#16: duplicate keys on either side and feature rows without a label."""
    keys = ["entity", "year", "weekofyear"]
    return J.join_key_violations(P.panel_features(spark, sf).select(*keys), P.panel_labels(spark, sf), keys)


@query("entity_profile", Q.with_ctes(*Q.PANEL_CTES, body=(
    "SELECT entity, count(*) FILTER (WHERE split = 'train') AS train_weeks, "
    "min(period) FILTER (WHERE split = 'train') AS first_train_period, "
    "max(period) FILTER (WHERE split = 'train') AS last_train_period, "
    "count(*) FILTER (WHERE split = 'test') AS test_weeks FROM weekly_panel GROUP BY entity")))
def q_entity_profile(spark, sf):
    """#20: per entity train weeks, first/last train period, test weeks."""
    p = P.scan_panel(spark, sf)
    tr = F.col("split") == "train"
    return p.groupBy("entity").agg(
        F.count_if(tr).alias("train_weeks"),
        F.min(F.when(tr, F.col("period"))).alias("first_train_period"),
        F.max(F.when(tr, F.col("period"))).alias("last_train_period"),
        F.count_if(F.col("split") == "test").alias("test_weeks"))


@query("union_train_test", Q.with_ctes(*Q.PANEL_CTES, body=(
    "SELECT entity, period, target, 'train' AS split FROM weekly_panel WHERE split = 'train' "
    "UNION ALL SELECT entity, period, CAST(NULL AS BIGINT), 'test' FROM weekly_panel WHERE split = 'test'")))
def q_union_train_test(spark, sf):
    """#56: tagged concatenation of the train frame and the (label-less) test frame."""
    p = P.scan_panel(spark, sf)
    train = p.filter(F.col("split") == "train").select("entity", "period", "target")
    test = p.filter(F.col("split") == "test").select("entity", "period")
    return FE.union_train_test(train, test, SPEC)


@query("union_entities", Q.with_ctes(*Q.naive_preds_ctes(), body=(
    "SELECT entity, model_key, count(*) AS n FROM preds GROUP BY entity, model_key")))
def q_union_entities(spark, sf):
    """#57: per-model prediction frames (each covering every entity) concatenated by name.

    In this design entities already share one long frame, so the reference's
    per-city concatenation becomes a union of independently produced result
    frames - the same ``unionByName`` that pools linear and tree predictions.
    """
    preds = FL.naive_predictions(spark, sf)
    parts = [preds.filter(F.col("model_key") == k) for k in NAIVE_KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity", "model_key").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- #
# 2.5 windows
# --------------------------------------------------------------------------- #
CLEAN_CTES = Q.PANEL_CTES + (("clean", Q.cleaned()),)


@query("impute_ffill", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(
    [f"{c}_ffill" for c in Q.BASE3], ["entity", "period", "split"],
    "(SELECT entity, period, split, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER ({Q.W_SPLIT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_ffill"
        for c in Q.BASE3) + " FROM weekly_panel) t")))
def q_impute_ffill(spark, sf):
    """#39: last observation carried forward within (entity, split)."""
    p = C.drop_redundant(P.scan_panel(spark, sf), P.REDUNDANT_COLUMNS).repartition("entity")
    f = C.impute_ffill(p, SPEC, Q.BASE3)
    return f.select("entity", "period", "split", *[F.col(c).alias(f"{c}_ffill") for c in Q.BASE3])


@query("impute_ffill_bfill", Q.with_ctes(*CLEAN_CTES, body=sel_sql(Q.BASE3, ["entity", "period", "split"], "clean")))
def q_impute_ffill_bfill(spark, sf):
    """#40: forward fill then backward fill of leading gaps, within (entity, split)."""
    return FL.cleaned_panel(spark, sf).select("entity", "period", "split", *Q.BASE3)


def _lag_names():
    return [f"{c}_lag_{k}" for c in Q.BASE3 for k in FE.DEFAULT_LAGS]


def _roll_names(stat):
    return [f"{c}_roll{stat}_{w}" for c in Q.BASE3 for w in FE.DEFAULT_WINDOWS]


@query("lag_features", Q.with_ctes(*CLEAN_CTES, body=sel_sql(_lag_names(), ["entity", "period", "split"], (
    "(SELECT entity, period, split, " + ", ".join(
        f"{Q.lag(c, k)} AS {c}_lag_{k}" for c in Q.BASE3 for k in FE.DEFAULT_LAGS) + " FROM clean) t"))))
def q_lag_features(spark, sf):
    """#41: predictors shifted 1..4 rows, partitioned by entity only."""
    f = FE.lag_features(FL.cleaned_panel(spark, sf), SPEC, Q.BASE3)
    return f.select("entity", "period", "split", *_lag_names())


@query("rolling_mean", Q.with_ctes(*CLEAN_CTES, body=sel_sql(_roll_names("mean"), ["entity", "period", "split"], (
    "(SELECT entity, period, split, " + ", ".join(
        f"{Q.roll(c, w, 'mean')} AS {c}_rollmean_{w}" for c in Q.BASE3 for w in FE.DEFAULT_WINDOWS) + " FROM clean) t"))))
def q_rolling_mean(spark, sf):
    """#42: trailing mean of the w previous rows, min observations max(2, w//2)."""
    f = FE.rolling_mean(FL.cleaned_panel(spark, sf), SPEC, Q.BASE3)
    return f.select("entity", "period", "split", *_roll_names("mean"))


@query("rolling_std", Q.with_ctes(*CLEAN_CTES, body=sel_sql(_roll_names("std"), ["entity", "period", "split"], (
    "(SELECT entity, period, split, " + ", ".join(
        f"{Q.roll(c, w, 'std')} AS {c}_rollstd_{w}" for c in Q.BASE3 for w in FE.DEFAULT_WINDOWS) + " FROM clean) t"))))
def q_rolling_std(spark, sf):
    """#43: trailing sample std over the same frame."""
    f = FE.rolling_std(FL.cleaned_panel(spark, sf), SPEC, Q.BASE3)
    return f.select("entity", "period", "split", *_roll_names("std"))


@query("seasonality", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(Q.SEASON_COLS, ["entity", "period"], (
    f"(SELECT entity, period, {Q.SEASON_SQL} FROM weekly_panel) t"))))
def q_seasonality(spark, sf):
    """#58: cyclic week-of-year / month encodings."""
    return FE.add_seasonality(P.scan_panel(spark, sf), SPEC).select("entity", "period", *Q.SEASON_COLS)


ENG_NAMES = Q.feature_names()


@query("drop_undefined_lags", Q.with_ctes(*Q.engineered_ctes(), body=(
    "SELECT entity, split, count(*) AS n_rows, min(period) AS first_period FROM eng GROUP BY entity, split")))
def q_drop_undefined_lags(spark, sf):
    """#12: rows kept after dropping train rows with undefined engineered features."""
    eng, _, _ = FL.engineered_panel(spark, sf)
    return eng.groupBy("entity", "split").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.min("period").alias("first_period"))


@query("test_residual_fill", Q.with_ctes(*Q.engineered_ctes(), body=sel_sql(
    ENG_NAMES, ["entity", "period"], "eng", "WHERE split = 'test'")))
def q_test_residual_fill(spark, sf):
    """#46 (with #41-#43, #58): every engineered feature of the test rows after the in-block fill."""
    eng, names, _ = FL.engineered_panel(spark, sf)
    return eng.filter(F.col("split") == "test").select("entity", "period", *names)


@query("engineered_features", Q.with_ctes(*Q.engineered_ctes(), body=sel_sql(
    ENG_NAMES, ["entity", "period", "split", "target"], "eng")))
def q_engineered_features(spark, sf):
    """#8 + #41-#46 + #58: the full engineered matrix (base, seasonality, lags, rolling)."""
    eng, names, _ = FL.engineered_panel(spark, sf)
    return eng.select("entity", "period", "split", "target", *names)


@query("case_lags", Q.with_ctes(*Q.engineered_ctes(ar=True), body=sel_sql(
    Q.CASE_NAMES[:-1], ["entity", "period", "split"], "eng")))
def q_case_lags(spark, sf):
    """#44: autoregressive case lags after the leading-row drop (test rows NULL)."""
    eng, _, case = FL.engineered_panel(spark, sf, autoregressive=True)
    return eng.select("entity", "period", "split", *case[:-1])


@query("case_rolling", Q.with_ctes(*Q.engineered_ctes(ar=True), body=sel_sql(
    ["cases_rollmean_4"], ["entity", "period", "split"], "eng")))
def q_case_rolling(spark, sf):
    """#45: trailing 4-row mean of the target (min 2), NULL placeholders on test."""
    eng, _, case = FL.engineered_panel(spark, sf, autoregressive=True)
    return eng.select("entity", "period", "split", case[-1])


@query("temporal_split", Q.with_ctes(*Q.split_ctes(), body=(
    "SELECT entity, role, count(*) AS n_rows, min(period) AS first_period, max(period) AS last_period "
    "FROM spl GROUP BY entity, role")))
def q_temporal_split(spark, sf):
    """#47: earliest floor(0.75 n) usable train rows fit, the rest hold-out, per entity."""
    eng, _, _ = FL.engineered_panel(spark, sf)
    spl = S.temporal_split(eng.filter(F.col("split") == "train"), SPEC)
    return spl.groupBy("entity", "role").agg(F.count(F.lit(1)).alias("n_rows"),
                                             F.min("period").alias("first_period"),
                                             F.max("period").alias("last_period"))


CV_SQL = Q.with_ctes(*Q.split_ctes(), ("fitrows", (
    "SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY period) - 1 AS pos, "
    "count(*) OVER (PARTITION BY entity) AS n FROM spl WHERE role = 'fit'")), ("folds", (
    "SELECT entity, period, fold, CASE WHEN pos < n - (4 - fold) * (n // 5) THEN 'train' "
    "WHEN pos < n - (4 - fold) * (n // 5) + (n // 5) THEN 'valid' END AS cv_role "
    "FROM fitrows, range(0, 4) r(fold)")),
    body="SELECT entity, CAST(fold AS INTEGER) AS fold, cv_role, count(*) AS n_rows, min(period) AS first_period, "
         "max(period) AS last_period FROM folds WHERE cv_role IS NOT NULL GROUP BY ALL")


@query("timeseries_cv_folds", CV_SQL)
def q_timeseries_cv_folds(spark, sf):
    """#48: expanding TimeSeriesSplit folds (S = 4) over the fit rows."""
    eng, _, _ = FL.engineered_panel(spark, sf)
    fit = S.temporal_split(eng.filter(F.col("split") == "train"), SPEC).filter(F.col("role") == "fit")
    folds = S.timeseries_cv_folds(fit.select("entity", "period"), SPEC, 4)
    return folds.groupBy("entity", "fold", "cv_role").agg(F.count(F.lit(1)).alias("n_rows"),
                                                          F.min("period").alias("first_period"),
                                                          F.max("period").alias("last_period"))


# --------------------------------------------------------------------------- #
# 2.8 scalar functions
# --------------------------------------------------------------------------- #
@query("target_transform", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(
    ["target_t"], ["entity", "period"], "(SELECT entity, period, ln(1 + CAST(target AS DOUBLE)) AS target_t "
    "FROM weekly_panel WHERE split = 'train') t")))
def q_target_transform(spark, sf):
    """#59: log1p of the target on train rows."""
    p = P.scan_panel(spark, sf).filter(F.col("split") == "train")
    return p.select("entity", "period", log1p_target("target").alias("target_t"))


@query("inverse_target_transform", Q.with_ctes(*Q.PANEL_CTES, body=sel_sql(
    ["x", "y"], ["entity", "period"], "(SELECT entity, period, x, CASE WHEN x IS NOT NULL THEN "
    "greatest(exp(x) - 1, 0.0) END AS y FROM (SELECT entity, period, ln(1 + CAST(target AS DOUBLE)) - 3.0 AS x "
    "FROM weekly_panel WHERE split = 'train') s) t")))
def q_inverse_target_transform(spark, sf):
    """#60: expm1 then clip at 0 (values shifted below 0 on the log scale to exercise the clip)."""
    p = P.scan_panel(spark, sf).filter(F.col("split") == "train")
    x = (log1p_target("target") - F.lit(3.0)).alias("x")
    return p.select("entity", "period", x).select("entity", "period", "x", expm1_clip("x").alias("y"))


@query("round_counts", Q.with_ctes(*Q.naive_preds_ctes(), body=(
    "SELECT entity, model_key, period, CAST(round_even(predicted, 0) AS BIGINT) AS predicted_count FROM preds")))
def q_round_counts(spark, sf):
    """#61: half-to-even rounding of predictions to integer counts."""
    preds = FL.naive_predictions(spark, sf)
    return preds.select("entity", "model_key", "period", rint_long("predicted").alias("predicted_count"))


@query("residuals", Q.with_ctes(*Q.naive_preds_ctes(), body=sel_sql(
    ["actual", "predicted", "residual"], ["entity", "model_key", "period"],
    "(SELECT *, actual - predicted AS residual FROM preds) t")))
def q_residuals(spark, sf):
    """#62: actual - predicted per hold-out period."""
    return M.residuals(FL.naive_predictions(spark, sf))


# --------------------------------------------------------------------------- #
# 2.4 evaluation
# --------------------------------------------------------------------------- #
@query("flagship", Q.with_ctes(*Q.flagship_ctes(), ("pr", (
    "SELECT entity, role, CAST(target AS DOUBLE) AS actual, "
    f"lag(CAST(target AS DOUBLE), 1) OVER ({Q.W_ENTITY}) AS predicted FROM tr")),
    body=f"SELECT entity, 'naive_lag1' AS model_key, {Q.metric_sql()} FROM pr WHERE role = 'holdout' GROUP BY entity"))
def q_flagship(spark, sf):
    """entry(): impute -> lag/roll -> drop -> 75 % split -> naive lag-1 -> metrics."""
    return FL.flagship(spark, sf)


PRED_CTES = Q.naive_preds_ctes()


@query("forecast_metrics", Q.with_ctes(*PRED_CTES, body=(
    f"SELECT entity, model_key, {Q.metric_sql()} FROM preds GROUP BY entity, model_key")))
def q_forecast_metrics(spark, sf):
    """#23: MAE / RMSE / R^2 per (entity, model)."""
    return M.forecast_metrics(FL.naive_predictions(spark, sf))


MODEL_ORDER_SQL = "CASE model_key " + " ".join(
    f"WHEN '{k}' THEN {i}" for k, i in M.MODEL_ORDER.items()) + f" ELSE {len(M.MODEL_ORDER)} END"
DISPLAY_SQL = "CASE model_key " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in M.ALL_DISPLAY_NAMES.items()) + " ELSE model_key END"


@query("combined_scores", Q.with_ctes(*PRED_CTES, ("pooled", (
    f"SELECT model_key, {Q.metric_sql()} FROM preds GROUP BY model_key")),
    body=(f"SELECT CAST(row_number() OVER (ORDER BY mae, {MODEL_ORDER_SQL}, model_key) AS INTEGER) AS rank, {DISPLAY_SQL} AS model, "
          "model_key, n, mae, rmse, r2 FROM pooled")))
def q_combined_scores(spark, sf):
    """#24: every entity's predictions pooled per model, ranked by MAE."""
    return M.combined_scores(FL.naive_predictions(spark, sf))


@query("rank_combined", Q.with_ctes(*PRED_CTES, ("pooled", (
    f"SELECT model_key, {Q.metric_sql()} FROM preds GROUP BY model_key")),
    body=f"SELECT CAST(row_number() OVER (ORDER BY mae, {MODEL_ORDER_SQL}, model_key) AS INTEGER) AS rank, model_key, mae FROM pooled"))
def q_rank_combined(spark, sf):
    """#51: global rank by pooled MAE."""
    return M.combined_scores(FL.naive_predictions(spark, sf)).select("rank", "model_key", "mae")


METRICS_CTES = PRED_CTES + (("met", f"SELECT entity, model_key, {Q.metric_sql()} FROM preds GROUP BY entity, model_key"),)


@query("metrics_table", Q.with_ctes(*METRICS_CTES, body=(
    f"SELECT entity, {DISPLAY_SQL} AS model, model_key, mae, rmse, r2, "
    "model_key IN ('decision_tree', 'random_forest', 'xgboost', 'lightgbm') AS tuned FROM met")))
def q_metrics_table(spark, sf):
    """#25: tidy metrics with display names and the tuned flag."""
    return M.metrics_table(M.forecast_metrics(FL.naive_predictions(spark, sf)))


@query("rank_models", Q.with_ctes(*METRICS_CTES, body=(
    f"SELECT entity, model_key, mae, CAST(row_number() OVER (PARTITION BY entity ORDER BY mae, {MODEL_ORDER_SQL}, model_key) "
    f"AS INTEGER) AS rank_mae, CAST(row_number() OVER (PARTITION BY entity ORDER BY r2 DESC, {MODEL_ORDER_SQL}, model_key) AS INTEGER) AS rank_r2 "
    "FROM met")))
def q_rank_models(spark, sf):
    """#50: unique ranks per entity (ascending MAE; descending R^2)."""
    m = M.forecast_metrics(FL.naive_predictions(spark, sf))
    a = M.rank_models(m, "mae").withColumnRenamed("rank", "rank_mae")
    return M.rank_models(a, "r2").withColumnRenamed("rank", "rank_r2").select(
        "entity", "model_key", "mae", "rank_mae", "rank_r2")


@query("best_model_per_entity", Q.with_ctes(*METRICS_CTES, body=(
    f"SELECT entity, model_key, n, mae, rmse, r2 FROM met QUALIFY row_number() OVER "
    f"(PARTITION BY entity ORDER BY mae, {MODEL_ORDER_SQL}, model_key) = 1")))
def q_best_model_per_entity(spark, sf):
    """#26: argmin MAE per entity."""
    return M.best_model_per_entity(M.forecast_metrics(FL.naive_predictions(spark, sf)))


@query("model_comparison_pivot", Q.with_ctes(*METRICS_CTES, ("lng", (
    "SELECT entity, model_key, 'mae' AS metric, mae AS value FROM met UNION ALL "
    "SELECT entity, model_key, 'rmse', rmse FROM met UNION ALL SELECT entity, model_key, 'r2', r2 FROM met")),
    body="SELECT metric, model_key, " + ", ".join(
        f"{Q.r6(f'max(value) FILTER (WHERE entity = {chr(39)}{e}{chr(39)})')} AS {e}" for e in ENTITIES)
    + " FROM lng GROUP BY metric, model_key"))
def q_model_comparison_pivot(spark, sf):
    """#33: model x entity tables of mae / rmse / r2."""
    return M.model_comparison_pivot(M.forecast_metrics(FL.naive_predictions(spark, sf)))


# --------------------------------------------------------------------------- #
# 2.4 / 2.9 diagnostics and chart data
# --------------------------------------------------------------------------- #
from ..operators import eda as D  # noqa: E402
from ..operators import scale as SC  # noqa: E402
from ..operators import select as SEL  # noqa: E402


def _union_long(src: str, cols: list[str], value_name: str, extra_sel: str = "entity, split") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra_sel}, '{c}' AS feature, {i} AS idx, {c} AS {value_name} FROM {src}" for i, c in enumerate(cols))


MISS_SQL = Q.with_ctes(*Q.PANEL_CTES, ("m", (
    "SELECT entity, split, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in Q.BASE3)
    + " FROM weekly_panel GROUP BY entity, split")), ("l", _union_long("m", Q.BASE3, "n_missing")),
    body=("SELECT entity, split, feature, n_missing, CAST(sum(n_missing) OVER (PARTITION BY entity, split) AS BIGINT) "
          "AS total_missing, CASE WHEN n_missing > 0 AND row_number() OVER (PARTITION BY entity, split ORDER BY "
          "n_missing DESC, idx) <= 3 THEN CAST(row_number() OVER (PARTITION BY entity, split ORDER BY n_missing DESC, "
          "idx) AS INTEGER) END AS worst_rank FROM l"))


@query("missing_counts", MISS_SQL)
def q_missing_counts(spark, sf):
    """#21: missing cells per feature per (entity, split) before imputation, total and worst 3."""
    p = C.drop_redundant(P.scan_panel(spark, sf), P.REDUNDANT_COLUMNS)
    return D.missing_counts(p, SPEC, Q.BASE3)


GROUPS = [f"{e}_{s}" for e in ENTITIES for s in ("train", "test")]
MSUM_SQL = Q.with_ctes(*Q.PANEL_CTES, ("m", (
    "SELECT entity || '_' || split AS grp, " + ", ".join(
        f"avg(CAST({c} IS NULL AS DOUBLE)) * 100.0 AS {c}" for c in RAW_F) + " FROM weekly_panel GROUP BY 1")),
    ("l", _union_long("m", RAW_F, "pct", "grp")),
    ("w", "SELECT feature, idx, " + ", ".join(f"max(pct) FILTER (WHERE grp = '{g}') AS {g}" for g in GROUPS)
     + f", greatest({', '.join(GROUPS)}) AS max_pct FROM l GROUP BY feature, idx"),
    body=("SELECT feature, " + ", ".join(f"{Q.r6(g)} AS {g}" for g in GROUPS) + f", {Q.r6('max_pct')} AS max_pct, "
          "CAST(row_number() OVER (ORDER BY max_pct DESC, idx) AS INTEGER) AS rank_order FROM w"))


@query("missing_summary", MSUM_SQL)
def q_missing_summary(spark, sf):
    """#22: % missing per feature x (entity, split) on raw rows (redundant column included), worst first."""
    out = D.missing_summary(P.scan_panel(spark, sf), SPEC, RAW_F)
    return out.withColumnRenamed("order", "rank_order")


CORR_COLS = Q.BASE3 + ["target"]


def _corr_sql():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS[: i + 1]):
            xa, xb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            num = f"covar_pop({xa}, {xb})"
            den = (f"(stddev_pop({xa}) FILTER (WHERE {xa} IS NOT NULL AND {xb} IS NOT NULL) * "
                   f"stddev_pop({xb}) FILTER (WHERE {xa} IS NOT NULL AND {xb} IS NOT NULL))")
            parts.append(f"SELECT entity, '{a}' AS feature_a, '{b}' AS feature_b, {i} AS idx_a, {j} AS idx_b, "
                         f"{Q.r6(f'{num} / nullif({den}, 0)')} AS corr FROM clean WHERE split = 'train' GROUP BY entity")
    return " UNION ALL ".join(parts)


@query("correlation_matrix", Q.with_ctes(*CLEAN_CTES, body=_corr_sql()))
def q_correlation_matrix(spark, sf):
    """#27: pairwise-complete Pearson r (lower triangle) of cleaned train predictors + target."""
    tr = FL.cleaned_panel(spark, sf).filter(F.col("split") == "train")
    cols = numeric_columns(tr, feature_columns(tr, SPEC) + [SPEC.target])   # #8 + #14
    return D.correlation_matrix(tr, SPEC, cols)


SKEW_SQL = ("SELECT entity, count(target) AS n, CASE WHEN count(target) > 2 THEN skewness(CAST(target AS DOUBLE)) END "
            "AS skew_raw, CASE WHEN count(target) > 2 THEN skewness(ln(1 + CAST(target AS DOUBLE))) END AS skew_log1p "
            "FROM weekly_panel WHERE split = 'train' GROUP BY entity")


@query("target_skew", Q.with_ctes(*Q.PANEL_CTES, ("sk", SKEW_SQL), body=sel_sql(
    ["skew_raw", "skew_log1p"], ["entity", "n"], "sk")))
def q_target_skew(spark, sf):
    """#28: bias-corrected skew of the target, raw and log1p."""
    return D.target_skew(P.scan_panel(spark, sf).filter(F.col("split") == "train"), SPEC)


def _hist_sql(values_cte: str, groups: str, bins: int, density: bool) -> tuple:
    g_using = groups
    st = (f"SELECT {groups}, count(x) AS n, CASE WHEN max(x) > min(x) THEN min(x) ELSE min(x) - 0.5 END AS lo, "
          f"CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / {bins} ELSE CAST(1.0 / {bins} AS DOUBLE) END AS width "
          f"FROM {values_cte} WHERE x IS NOT NULL GROUP BY {groups}")
    cnt = (f"SELECT {groups}, CAST(least(floor((x - lo) / width) + 1, {bins}) AS INTEGER) AS bin, count(*) AS cnt "
           f"FROM {values_cte} JOIN hst USING ({g_using}) WHERE x IS NOT NULL GROUP BY ALL")
    grid = f"SELECT {groups}, n, lo, width, CAST(b AS INTEGER) AS bin FROM hst, range(1, {bins + 1}) r(b)"
    dens = f", {Q.r6('coalesce(cnt, 0) / (n * width)')} AS density" if density else ""
    body = (f"SELECT {groups}, bin, {Q.r6('lo + (bin - 1) * width')} AS bin_lo, {Q.r6('lo + bin * width')} AS bin_hi, "
            f"coalesce(cnt, 0) AS count{dens} FROM hgrid LEFT JOIN hcnt USING ({g_using}, bin)")
    return ("hst", st), ("hcnt", cnt), ("hgrid", grid), body


_h = _hist_sql("hv", "entity, scale", 40, True)
HIST_SQL = Q.with_ctes(*Q.PANEL_CTES, ("hv", (
    "SELECT entity, 'raw' AS scale, CAST(target AS DOUBLE) AS x FROM weekly_panel WHERE split = 'train' UNION ALL "
    "SELECT entity, 'log1p', ln(1 + CAST(target AS DOUBLE)) FROM weekly_panel WHERE split = 'train'")),
    *_h[:3], body=_h[3])


@query("target_histogram", HIST_SQL)
def q_target_histogram(spark, sf):
    """#29: 40 equal-width bins, density, raw and log1p target."""
    return D.target_histogram(P.scan_panel(spark, sf).filter(F.col("split") == "train"), SPEC, 40)


_rh = _hist_sql("hv", "entity, model_key", 30, False)
RHIST_SQL = Q.with_ctes(*PRED_CTES, ("hv", "SELECT entity, model_key, actual - predicted AS x FROM preds"),
                        *_rh[:3], ("hb", _rh[3]),
                        ("mr", "SELECT entity, model_key, avg(actual - predicted) AS mean_residual FROM preds GROUP BY ALL"),
                        body=f"SELECT hb.*, {Q.r6('mean_residual')} AS mean_residual FROM hb JOIN mr USING (entity, model_key)")


@query("residual_histogram", RHIST_SQL)
def q_residual_histogram(spark, sf):
    """#30: 30-bin residual histogram and mean residual per (entity, model)."""
    return D.residual_histogram(FL.naive_predictions(spark, sf), 30)


KDE_SQL = Q.with_ctes(*PRED_CTES, (
    "r", "SELECT entity, model_key, actual - predicted AS residual FROM preds"), (
    "st", "SELECT entity, model_key, min(residual) AS mn, max(residual) AS mx, count(residual) AS n, "
          "stddev_samp(residual) AS sd FROM r GROUP BY ALL"), (
    "st2", "SELECT *, pow(CAST(n AS DOUBLE), -0.2) * sd AS h FROM st"), (
    "g", "SELECT entity, model_key, h, CAST(i AS INTEGER) AS grid_idx, mn + (mx - mn) * i / 199 AS x "
         "FROM st2, range(0, 200) t(i)"),
    body=(f"SELECT g.entity, g.model_key, grid_idx, {Q.r6('x')} AS x, "
          + Q.r6("sum(exp(-0.5 * ((x - residual) / h) * ((x - residual) / h))) / (count(*) * h * sqrt(2 * pi()))")
          + " AS density FROM g JOIN r USING (entity, model_key) GROUP BY g.entity, g.model_key, grid_idx, x, h"))


@query("residual_kde", KDE_SQL)
def q_residual_kde(spark, sf):
    """#31: Gaussian KDE (Scott bandwidth) of the residuals on a 200-point grid."""
    return D.residual_kde(FL.naive_predictions(spark, sf), 200)


@query("scatter_limits", Q.with_ctes(*PRED_CTES, body=(
    f"SELECT entity, model_key, {Q.r6('greatest(max(actual), max(predicted)) * 1.05 + 1')} AS axis_max "
    "FROM preds GROUP BY ALL")))
def q_scatter_limits(spark, sf):
    """#32: square scatter axis bound."""
    return D.scatter_limits(FL.naive_predictions(spark, sf))


@query("actual_vs_predicted", Q.with_ctes(*METRICS_CTES, body=sel_sql(
    ["actual", "predicted", "mae", "rmse", "r2"], ["entity", "model_key", "period"],
    "preds JOIN met USING (entity, model_key)")))
def q_actual_vs_predicted(spark, sf):
    """#64: hold-out series with the model's metric annotation."""
    preds = FL.naive_predictions(spark, sf)
    return D.actual_vs_predicted(preds, M.forecast_metrics(preds)).select(
        "entity", "model_key", "period", "actual", "predicted", "mae", "rmse", "r2")


@query("timeline_model_order", Q.with_ctes(*METRICS_CTES, body=(
    "SELECT entity, model_key, mae, CAST(row_number() OVER (PARTITION BY entity ORDER BY mae, model_key) AS INTEGER) "
    "AS overlay_order FROM met")))
def q_timeline_model_order(spark, sf):
    """#55: overlay order of the models by MAE."""
    return D.timeline_model_order(M.forecast_metrics(FL.naive_predictions(spark, sf)))


NAIVE_KEYS = list(M.NAIVE_DISPLAY_NAMES)


@query("all_models_timeline", Q.with_ctes(*PRED_CTES, body=(
    "SELECT entity, period, " + ", ".join(f"{Q.r6(f'max(predicted) FILTER (WHERE model_key = {chr(39)}{k}{chr(39)})')} AS {k}"
                                          for k in NAIVE_KEYS)
    + f", {Q.r6('max(actual)')} AS actual FROM preds GROUP BY entity, period")))
def q_all_models_timeline(spark, sf):
    """#65: period x model wide table with the actual series."""
    return D.all_models_timeline(FL.naive_predictions(spark, sf), NAIVE_KEYS)


@query("target_overview", Q.with_ctes(*Q.PANEL_CTES, ("sk", SKEW_SQL), body=(
    f"SELECT p.entity, p.period, {Q.r6('CAST(p.target AS DOUBLE)')} AS target, "
    f"{Q.r6('ln(1 + CAST(p.target AS DOUBLE))')} AS target_log1p, sk.n, {Q.r6('skew_raw')} AS skew_raw, "
    f"{Q.r6('skew_log1p')} AS skew_log1p FROM weekly_panel p JOIN sk USING (entity) WHERE p.split = 'train'")))
def q_target_overview(spark, sf):
    """#66: target series per entity with raw / log1p skew."""
    return D.target_overview(P.scan_panel(spark, sf).filter(F.col("split") == "train"), SPEC)


# --------------------------------------------------------------------------- #
# scaling
# --------------------------------------------------------------------------- #
def _stats_sql(src_where: str) -> str:
    sel = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}__mean, coalesce(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) <> 0 "
                    f"THEN stddev_pop(CAST({c} AS DOUBLE)) END, 1.0) AS {c}__scale" for c in ENG_NAMES)
    return f"SELECT entity, {sel} FROM spl WHERE {src_where} GROUP BY entity"


SCALER_SQL = Q.with_ctes(*Q.split_ctes(), ("st", _stats_sql("role = 'fit'")), body=" UNION ALL ".join(
    f"SELECT entity, '{c}' AS feature, {i} AS feature_idx, {Q.r6(f'{c}__mean')} AS mean, {Q.r6(f'{c}__scale')} AS scale "
    f"FROM st" for i, c in enumerate(ENG_NAMES)))


def _fit_rows(spark, sf):
    eng, names, _ = FL.engineered_panel(spark, sf)
    return S.temporal_split(eng.filter(F.col("split") == "train"), SPEC), names


@query("scaler_fit", SCALER_SQL)
def q_scaler_fit(spark, sf):
    """#37: per (entity, feature) train-only mean and population std (0 -> 1)."""
    spl, names = _fit_rows(spark, sf)
    stats = SC.scaler_fit(spl.filter(F.col("role") == "fit"), "entity", names)
    return SC.scaler_long(stats, "entity", names)


SCALED_SQL = Q.with_ctes(*Q.split_ctes(), ("st", _stats_sql("role = 'fit'")), body=(
    "SELECT entity, period, role, " + ", ".join(f"{Q.r6(f'({c} - {c}__mean) / {c}__scale')} AS {c}" for c in ENG_NAMES)
    + " FROM spl JOIN st USING (entity)"))


@query("scale_features", SCALED_SQL)
def q_scale_features(spark, sf):
    """#63: (x - mean) / std of fit and hold-out rows with fit-row statistics."""
    spl, names = _fit_rows(spark, sf)
    scaled, _ = SC.scale_features(spl, "entity", names, F.col("role") == "fit")
    return scaled.select("entity", "period", "role", *names)


APPLY_SQL = Q.with_ctes(*Q.split_ctes(), ("st", _stats_sql("true")), body=(
    "SELECT entity, period, " + ", ".join(f"{Q.r6(f'({c} - {c}__mean) / {c}__scale')} AS {c}" for c in ENG_NAMES)
    + " FROM eng JOIN st USING (entity) WHERE split = 'test'"))


@query("apply_fitted_stats", APPLY_SQL)
def q_apply_fitted_stats(spark, sf):
    """#17: statistics fitted on all usable train rows applied to the test rows (broadcast if small)."""
    eng, names, _ = FL.engineered_panel(spark, sf)
    stats = SC.scaler_fit(eng.filter(F.col("split") == "train"), "entity", names)
    test = eng.filter(F.col("split") == "test")
    return SC.apply_fitted_stats(test, stats, "entity", names).select("entity", "period", *names)


# --------------------------------------------------------------------------- #
# 2.3 / 2.5 / 2.6 selection
# --------------------------------------------------------------------------- #
MI_CTES = Q.split_ctes() + Q.mi_ctes(ENG_NAMES)
SEL_CTES = MI_CTES + (("sel", (
    "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mi DESC NULLS LAST, feature_idx DESC) <= 30 AS selected "
    "FROM mi")), ("sel2", (
    "SELECT *, CASE WHEN selected THEN CAST(row_number() OVER (PARTITION BY entity, selected ORDER BY feature_idx) "
    "AS INTEGER) END AS sel_order FROM sel")))


def _fit_points(spark, sf):
    spl, names = _fit_rows(spark, sf)
    fit = spl.filter(F.col("role") == "fit").select("entity", "period", log1p_target("target").alias("target_t"), *names)
    return fit, names


_MI: dict = {}


def mi_scores(spark, sf):
    """KSG scores of the fit rows, computed once per session and checkpointed (shared by #49, #52, #53, #13)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MI:
        fit, names = _fit_points(spark, sf)
        _MI[key] = cut_lineage(SEL.mutual_info_ksg(fit, "entity", "period", "target_t", names, k=3))
    return _MI[key]


@query("ksg_neighbors", Q.with_ctes(*MI_CTES, body=f"SELECT entity, feature, rid, {Q.r6('eps')} AS eps FROM mie"))
def q_ksg_neighbors(spark, sf):
    """#19: exact Chebyshev distance to the 3rd neighbour (grid equi-join, no all-pairs)."""
    fit, names = _fit_points(spark, sf)
    pts = SEL.mi_points(fit, "entity", "period", "target_t", names)
    return SEL.knn_radius(pts, "entity", 3).select("entity", "feature", F.col("rid").cast("long").alias("rid"), "eps")


@query("mutual_info_ksg", Q.with_ctes(*MI_CTES, body=sel_sql(["mi"], ["entity", "feature", "feature_idx", "n"], "mi")))
def q_mutual_info_ksg(spark, sf):
    """#49: KSG mutual information of each engineered feature with log1p(target) on the fit rows."""
    return mi_scores(spark, sf)


@query("select_top_k", Q.with_ctes(*SEL_CTES, body=sel_sql(
    ["mi"], ["entity", "feature", "feature_idx", "n", "selected", "sel_order"], "sel2")))
def q_select_top_k(spark, sf):
    """#52: top-30 features per entity by MI, in original column order."""
    return SEL.select_top_k(mi_scores(spark, sf), "entity", 30)


@query("mi_score_ranking", Q.with_ctes(*SEL_CTES, body=(
    f"SELECT entity, feature, feature_idx, n, {Q.r6('mi')} AS mi, selected, CAST(mi_rank AS INTEGER) AS mi_rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mi DESC NULLS LAST, feature_idx DESC) AS mi_rank "
    "FROM sel) t WHERE mi_rank <= 30")))
def q_mi_score_ranking(spark, sf):
    """#53: MI scores descending, top 30 per entity, with the selected flag."""
    scores = mi_scores(spark, sf).cache()
    return SEL.mi_score_ranking(scores, SEL.select_top_k(scores, "entity", 30), "entity", 30)


ALIGN_LONG = " UNION ALL ".join(f"SELECT entity, period, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM spl "
                                f"WHERE role = 'fit'" for c in ENG_NAMES)


@query("align_selected", Q.with_ctes(*SEL_CTES, ("lng", ALIGN_LONG), body=(
    f"SELECT l.entity, l.period, l.feature, {Q.r6('l.value')} AS value, s.sel_order FROM lng l JOIN sel2 s "
    "ON l.entity = s.entity AND l.feature = s.feature WHERE s.selected")))
def q_align_selected(spark, sf):
    """#13: fit rows restricted to each entity's selected features, in fitted order (long form)."""
    spl, names = _fit_rows(spark, sf)
    fit = spl.filter(F.col("role") == "fit")
    args = [F.lit(len(names))]
    for c in names:
        args += [F.lit(c), F.col(c).cast("double")]
    long = fit.select("entity", "period", F.stack(*args).alias("feature", "value"))
    sel = SEL.select_top_k(mi_scores(spark, sf), "entity", 30)
    return SEL.align_selected(long, sel, "entity").select("entity", "period", "feature", "value", "sel_order")


# --------------------------------------------------------------------------- #
# 2.4 signal ablation (climate only vs climate + cases) on oracle-checkable OLS
# --------------------------------------------------------------------------- #
from ..operators import models as MD  # noqa: E402

SIGNALS = {"climate_only": "f_price_lag_1", "climate_cases": "cases_lag_1"}
SIG_CTES = Q.split_ctes(ar=True) + (("sig", " UNION ALL ".join(
    f"SELECT entity, period, role, target, ln(1 + CAST(target AS DOUBLE)) AS y, '{s}' AS signal, "
    f"CAST({x} AS DOUBLE) AS x FROM spl" for s, x in SIGNALS.items())), (
    "co", "SELECT entity, signal, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope FROM sig "
          "WHERE role = 'fit' GROUP BY ALL"), (
    "spred", "SELECT s.entity, s.signal, 'linear_regression' AS model_key, s.period, CAST(s.target AS DOUBLE) AS actual, "
             "greatest(exp(co.intercept + co.slope * s.x) - 1, 0.0) AS predicted FROM sig s JOIN co "
             "ON s.entity = co.entity AND s.signal = co.signal WHERE s.role = 'holdout'"), (
    "scmp", f"SELECT entity, signal, model_key, {Q.metric_sql(rounded=False)} FROM spred GROUP BY ALL"))


def _signal_frame(spark, sf):
    eng, _, _ = FL.engineered_panel(spark, sf, autoregressive=True)
    spl = S.temporal_split(eng.filter(F.col("split") == "train"), SPEC)
    parts = [spl.select("entity", "period", "role", "target", log1p_target("target").alias("y"),
                        F.lit(s).alias("signal"), F.col(x).cast("double").alias("x")) for s, x in SIGNALS.items()]
    return parts[0].unionByName(parts[1])


def _signal_coefs(sig):
    fit = sig.filter(F.col("role") == "fit")
    co = MD.fit_linear_family(fit, "entity", ["x"], "y", models=("linear_regression",), group_cols=("signal",))
    return co.select("entity", "signal", "model_key", "intercept", F.col("coef")[0].alias("slope"))


def _signal_preds(spark, sf):
    sig = _signal_frame(spark, sf)
    co = _signal_coefs(sig)
    ho = sig.filter(F.col("role") == "holdout").join(co, ["entity", "signal"])
    return ho.select("entity", "signal", "model_key", "period", F.col("target").cast("double").alias("actual"),
                     expm1_clip(F.col("intercept") + F.col("slope") * F.col("x")).alias("predicted"))


@query("ols_single_feature", Q.with_ctes(*SIG_CTES, body=sel_sql(["intercept", "slope"], ["entity", "signal"], "co")))
def q_ols_single_feature(spark, sf):
    """#68 (single feature): OLS of log1p(target) on one predictor per (entity, signal), from Gram sums."""
    return _signal_coefs(_signal_frame(spark, sf)).select("entity", "signal", "intercept", "slope")


@query("signal_comparison", Q.with_ctes(*SIG_CTES, body=sel_sql(
    ["mae", "rmse", "r2"], ["entity", "signal", "model_key", "n"], "scmp")))
def q_signal_comparison(spark, sf):
    """#34: hold-out metrics per (entity, signal, model) for climate-only vs climate + cases."""
    return M.signal_comparison(_signal_preds(spark, sf))


@query("signal_improvement", Q.with_ctes(*SIG_CTES, ("piv", (
    "SELECT entity, model_key, avg(rmse) FILTER (WHERE signal = 'climate_only') AS rmse_base, "
    "avg(rmse) FILTER (WHERE signal = 'climate_cases') AS rmse_extended FROM scmp GROUP BY ALL")),
    body=sel_sql(["rmse_base", "rmse_extended", "improvement", "pct_cut"], ["entity", "model_key"], (
        "(SELECT *, rmse_base - rmse_extended AS improvement, 100.0 * (rmse_base - rmse_extended) / rmse_base "
        "AS pct_cut FROM piv) t"))))
def q_signal_improvement(spark, sf):
    """#35: mean RMSE by signal per (entity, model), improvement and % cut."""
    return M.signal_improvement(M.signal_comparison(_signal_preds(spark, sf)), "climate_only", "climate_cases")


@query("signal_average", Q.with_ctes(*SIG_CTES, ("av", (
    "SELECT avg(rmse) FILTER (WHERE signal = 'climate_only') AS rmse_base, "
    "avg(rmse) FILTER (WHERE signal = 'climate_cases') AS rmse_extended FROM scmp")),
    body=sel_sql(["rmse_base", "rmse_extended", "pct_lower"], [],
                 "(SELECT *, 100.0 * (rmse_base - rmse_extended) / rmse_base AS pct_lower FROM av) t")))
def q_signal_average(spark, sf):
    """#36: average RMSE per signal and the % lower error."""
    return M.signal_average(M.signal_comparison(_signal_preds(spark, sf)), "climate_only", "climate_cases")


# --------------------------------------------------------------------------- #
# 2.10 CV scoring on oracle-checkable candidates (naive predictors per fold)
# --------------------------------------------------------------------------- #
def _fold_naive_preds(spark, sf):
    """Per fold: the validation rows scored by two naive candidates on the log scale."""
    eng, _, _ = FL.engineered_panel(spark, sf)
    fit = S.temporal_split(eng.filter(F.col("split") == "train"), SPEC).filter(F.col("role") == "fit")
    folds = S.timeseries_cv_folds(fit.select("entity", "period", log1p_target("target").alias("actual_t")), SPEC, 4)
    w = Window.partitionBy("entity", "fold").orderBy("period")
    f4 = w.rowsBetween(-4, -1)
    y = F.col("actual_t")
    p = folds.select("entity", "fold", "cv_role", "period", "actual_t",
                     F.lag(y, 1).over(w).alias("naive_lag1"),
                     F.when(F.count(y).over(f4) >= 2, F.avg(y).over(f4)).alias("naive_roll4"))
    v = p.filter(F.col("cv_role") == "valid")
    return v.select("entity", "fold", "period", "actual_t", F.stack(
        F.lit(2), F.lit("naive_lag1"), F.col("naive_lag1"), F.lit("naive_roll4"), F.col("naive_roll4"))
        .alias("candidate", "predicted_t"))


FOLD_SQL = Q.with_ctes(*Q.split_ctes(), ("fitrows", (
    "SELECT entity, period, ln(1 + CAST(target AS DOUBLE)) AS actual_t, row_number() OVER (PARTITION BY entity "
    "ORDER BY period) - 1 AS pos, count(*) OVER (PARTITION BY entity) AS n FROM spl WHERE role = 'fit'")), ("folds", (
    "SELECT entity, period, actual_t, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < n - (4 - fold) * (n // 5) "
    "THEN 'train' WHEN pos < n - (4 - fold) * (n // 5) + (n // 5) THEN 'valid' END AS cv_role "
    "FROM fitrows, range(0, 4) r(fold)")), ("fp", (
    "SELECT entity, fold, cv_role, period, actual_t, lag(actual_t, 1) OVER (PARTITION BY entity, fold ORDER BY period) "
    "AS naive_lag1, CASE WHEN count(actual_t) OVER (PARTITION BY entity, fold ORDER BY period ROWS BETWEEN 4 PRECEDING "
    "AND 1 PRECEDING) >= 2 THEN avg(actual_t) OVER (PARTITION BY entity, fold ORDER BY period ROWS BETWEEN 4 PRECEDING "
    "AND 1 PRECEDING) END AS naive_roll4 FROM folds WHERE cv_role IS NOT NULL")), ("fv", (
    "SELECT entity, fold, period, actual_t, 'naive_lag1' AS candidate, naive_lag1 AS predicted_t FROM fp "
    "WHERE cv_role = 'valid' UNION ALL SELECT entity, fold, period, actual_t, 'naive_roll4', naive_roll4 FROM fp "
    "WHERE cv_role = 'valid'")), body="SELECT * FROM fv")


def _cv_sql(objective: str) -> str:
    if objective == "rmse":
        e = ("(CASE WHEN actual_t IS NOT NULL THEN greatest(exp(actual_t) - 1, 0.0) END - "
             "CASE WHEN predicted_t IS NOT NULL THEN greatest(exp(predicted_t) - 1, 0.0) END)")
        score = f"sqrt(avg({e} * {e}))"
    else:
        score = "avg(abs(actual_t - predicted_t))"
    body = (f"SELECT entity, candidate, {Q.r6('avg(score)')} AS cv_score, count(fold) AS n_folds, "
            "row_number() OVER (PARTITION BY entity ORDER BY avg(score), candidate) = 1 AS is_best FROM "
            f"(SELECT entity, candidate, fold, {score} AS score FROM fv GROUP BY ALL) t GROUP BY entity, candidate")
    return FOLD_SQL.replace("SELECT * FROM fv", body)


@query("cv_scores", _cv_sql("mae"))
def q_cv_scores(spark, sf):
    """#38: mean fold MAE (log scale) per candidate over the 4 expanding folds, best flagged."""
    return M.cv_scores(_fold_naive_preds(spark, sf), "mae")


@query("tune_objective", _cv_sql("rmse"))
def q_tune_objective(spark, sf):
    """#79: the 'rmse' objective - inverse-transform inside each fold, RMSE on the count scale."""
    return M.cv_scores(_fold_naive_preds(spark, sf), "rmse")


# --------------------------------------------------------------------------- #
# 2.10 models, tuning, forecasts, runs; 2.1 sinks (rows-only checks: no oracle SQL)
# --------------------------------------------------------------------------- #
from . import modelling as ML  # noqa: E402
from . import runs as RN  # noqa: E402

_RUNS: dict = {}
#: What the report, forecast and sink queries search for: the tree's whole grid.
#: Forest and boosters are in them with their defaults; run_weather_only,
#: run_autoregressive and signal_ablation search for all.
REPORT_TUNE = ("decision_tree",)


def _run(spark, sf, autoregressive=False, tune=REPORT_TUNE):
    key = (spark.sparkContext.applicationId, sf, autoregressive, tune)
    if key not in _RUNS:
        _RUNS[key] = RN.run_forecast(spark, sf, autoregressive, tune=tune)
    return _RUNS[key]


def _model_query(key: str, doc: str):
    def fn(spark, sf):
        st = RN.stack_for(spark, sf)
        if key in MD.LINEAR_MODELS:
            return ML.to_predictions(ML.linear_predictions(st, [key]))
        models = ML.tree_models(st, ML.given_params(st, {key: {}}), RN.QUERY_CFG)
        return ML.to_predictions(ML.tree_predictions(st, models))
    fn.__doc__ = doc
    return fn


for _k, _num, _what in [("linear_regression", 68, "OLS with intercept (Gram statistics, lstsq)"),
                        ("ridge", 69, "ridge alpha=1 (closed form on the Gram matrix)"),
                        ("lasso", 70, "lasso alpha=0.01 (coordinate descent on the Gram matrix)"),
                        ("elastic_net", 71, "elastic net alpha=0.01, l1_ratio=0.5"),
                        ("decision_tree", 72, "CART"),
                        ("random_forest", 73, "bagged trees"),
                        ("xgboost", 74, "level-wise boosting with l1 and l2 shrinkage"),
                        ("lightgbm", 75, "leaf-wise boosting")]:
    _name = {"linear_regression": "fit_linear_regression", "ridge": "fit_ridge", "lasso": "fit_lasso",
             "elastic_net": "fit_elastic_net", "decision_tree": "fit_decision_tree",
             "random_forest": "fit_random_forest", "xgboost": "fit_gbt_depthwise",
             "lightgbm": "fit_gbt_leafwise"}[_k]
    query(_name)(_model_query(_k, f"#{_num}: {_what}; hold-out predictions per entity."))


# --------------------------------------------------------------------------- #
# trees of depth one and two, checkable by SQL
# --------------------------------------------------------------------------- #
from ..operators import forest  # noqa: E402

TREE_INPUTS = ["f_price_lag_1", "cases_lag_1"]


def _tree_sql(depth: int) -> str:
    """Greedy splits by level: running sums over a node's values, the largest fall of the squared error, ties to the first feature and value."""
    points = " UNION ALL ".join(f"SELECT entity, period, {i} AS feature, CAST({c} AS DOUBLE) AS x, CAST(floor(ln(1 + CAST(target AS DOUBLE)) * 1048576 + 0.5) AS BIGINT) AS g FROM spl WHERE role = 'fit'" for i, c in enumerate(TREE_INPUTS))
    ctes = [*Q.split_ctes(ar=True), ("points", points), ("grid", "SELECT entity, feature, x, (x + lead(x) OVER (PARTITION BY entity, feature ORDER BY x)) / 2 AS threshold FROM (SELECT DISTINCT entity, feature, x FROM points) d"),
            ("rows0", "SELECT *, 'T' AS node FROM points")]
    for level in range(depth + 1):
        rows, each = f"rows{level}", "PARTITION BY entity, node, feature"
        ctes.append((f"totals{level}", f"SELECT entity, node, sum(g) / 1048576.0 AS g, count(*) AS n FROM {rows} WHERE feature = 0 GROUP BY ALL"))
        if level == depth:
            ctes.append((f"nodes{level}", f"SELECT entity, node, -1 AS feature, 0.0 AS threshold, g / n AS value FROM totals{level}"))
            break
        ctes += [
            (f"sides{level}", f"SELECT entity, node, feature, x, sum(sum(g)) OVER ({each} ORDER BY x) / 1048576.0 AS gl, sum(count(*)) OVER ({each} ORDER BY x) AS nl FROM {rows} GROUP BY entity, node, feature, x"),
            (f"best{level}", f"SELECT entity, node, s.feature, s.x FROM (SELECT s.*, s.gl * s.gl / s.nl + (t.g - s.gl) * (t.g - s.gl) / (t.n - s.nl) - t.g * t.g / t.n AS gain FROM sides{level} s JOIN totals{level} t USING (entity, node) WHERE s.nl < t.n) s "
                             "WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY entity, node ORDER BY gain DESC, feature, x) = 1"),
            (f"nodes{level}", f"SELECT t.entity, t.node, coalesce(b.feature, -1) AS feature, coalesce(c.threshold, 0.0) AS threshold, t.g / t.n AS value FROM totals{level} t LEFT JOIN best{level} b USING (entity, node) LEFT JOIN grid c ON c.entity = b.entity AND c.feature = b.feature AND c.x = b.x"),
            (f"rows{level + 1}", f"SELECT r.entity, r.period, r.feature, r.x, r.g, r.node || CASE WHEN k.x <= b.x THEN 'L' ELSE 'R' END AS node FROM {rows} r JOIN best{level} b ON b.entity = r.entity AND b.node = r.node JOIN points k ON k.entity = r.entity AND k.period = r.period AND k.feature = b.feature"),
        ]
    ctes.append(("nodes", " UNION ALL ".join(f"SELECT * FROM nodes{level}" for level in range(depth + 1))))
    return Q.with_ctes(*ctes, body=sel_sql(["threshold", "value"], ["entity", "node", "feature"], "nodes"))


def _small_tree(spark, sf, depth):
    """The nodes of each entity's tree by their way from the root (T, then L or R)."""
    eng, _, _ = FL.engineered_panel(spark, sf, autoregressive=True)
    fit = S.temporal_split(eng.filter(F.col("split") == "train"), SPEC).filter(F.col("role") == "fit")
    rows = fit.select("entity", "period", log1p_target("target").alias("y"), *TREE_INPUTS)
    params = rows.select("entity").distinct().select("entity", F.lit("decision_tree").alias("model_key"), F.lit(f'{{"max_depth": {depth}}}').alias("params"))
    trees = forest.fit_models(forest.packed_rows(rows, TREE_INPUTS, "y"), params, 0)
    nodes = trees.select("entity", F.posexplode(F.arrays_zip("feature", "threshold", "left", "right", "value")).alias("i", "n")).select("entity", "i", "n.*")
    at = nodes.where("i = 0").withColumn("node", F.lit("T"))
    out = at
    for _ in range(depth):
        child = at.where("feature >= 0").select("entity", "node", F.explode(F.array(F.struct(F.col("left").alias("i"), F.lit("L").alias("s")), F.struct(F.col("right").alias("i"), F.lit("R").alias("s")))).alias("c"))
        at = nodes.join(child.select("entity", F.concat("node", "c.s").alias("node"), F.col("c.i").alias("i")), ["entity", "i"]).select(*out.columns)
        out = out.unionByName(at)
    return out.select("entity", "node", "feature", "threshold", "value")


@query("tree_depth_one", _tree_sql(1))
def q_tree_depth_one(spark, sf):
    """#72: a tree of one split for each entity, on two features."""
    return _small_tree(spark, sf, 1)


@query("tree_depth_two", _tree_sql(2))
def q_tree_depth_two(spark, sf):
    """#72: a tree of two levels of splits for each entity, on two features."""
    return _small_tree(spark, sf, 2)


@query("feature_importance")
def q_feature_importance(spark, sf):
    """#76: importances of the tree models per entity (named by selected feature)."""
    return _run(spark, sf).importances


@query("top_importances")
def q_top_importances(spark, sf):
    """#54: top-20 importances per (entity, tree model)."""
    return RN.top_importances(_run(spark, sf).importances, 20)


def _tuned_table(spark, sf, key):
    st = RN.stack_for(spark, sf)
    return ML.tune_tree(st, key, RN.QUERY_CFG).select("entity", "model_key", F.col("params").alias("best_params"), F.col("cv_score").alias("best_cv_score"))


@query("tune_grid")
def q_tune_grid(spark, sf):
    """#77: exhaustive grid search (decision tree) with 4 expanding time-series folds."""
    return _tuned_table(spark, sf, "decision_tree")


@query("tune_random")
def q_tune_random(spark, sf):
    """#78: seeded random search (random forest) with the same CV."""
    return _tuned_table(spark, sf, "random_forest")


@query("train_evaluate")
def q_train_evaluate(spark, sf):
    """#80: one model (elastic net) through selection, scaling, fit, inverse transform and metrics."""
    st = RN.stack_for(spark, sf)
    return M.forecast_metrics(ML.to_predictions(ML.linear_predictions(st, ["elastic_net"])))


@query("forecast_direct")
def q_forecast_direct(spark, sf):
    """#81 (+ #18, #61): best model per entity refit on all train rows, test forecast, clipped and rounded."""
    return _run(spark, sf).submission


@query("forecast_recursive")
def q_forecast_recursive(spark, sf):
    """#82: autoregressive recursive forecast of the test weeks with each entity's best model."""
    return _run(spark, sf, True).submission


@query("run_weather_only")
def q_run_weather_only(spark, sf):
    """#83: full weather-only run - metrics table of all eight models."""
    return _run(spark, sf, tune=tuple(MD.TREE_MODELS)).metrics


@query("run_autoregressive")
def q_run_autoregressive(spark, sf):
    """#84: the same run with past-case features (1-week-ahead nowcast)."""
    return _run(spark, sf, True, tuple(MD.TREE_MODELS)).metrics


@query("signal_ablation")
def q_signal_ablation(spark, sf):
    """#85: tuned random forest and boosting on climate-only vs climate + cases features."""
    return RN.signal_ablation(spark, sf)


@query("sink_predictions")
def q_sink_predictions(spark, sf):
    """#4 + #2: hold-out predictions written per (entity, model) and read back by file path."""
    root = RN.output_root(spark)
    path = RN.write_predictions(_run(spark, sf).predictions, root)
    return RN.scan_holdout_predictions(spark, path)


@query("scan_holdout_predictions")
def q_scan_holdout_predictions(spark, sf):
    """#2: per-(entity, model) hold-out files; identity recovered from the file path."""
    root = RN.output_root(spark)
    preds = ML.to_predictions(ML.linear_predictions(RN.stack_for(spark, sf)))
    return RN.scan_holdout_predictions(spark, RN.write_predictions(preds, root))


@query("sink_reports")
def q_sink_reports(spark, sf):
    """#3: metrics, ranked, pooled and best tables written as CSV; the ranked table read back."""
    root = RN.output_root(spark)
    paths = RN.write_reports(_run(spark, sf), root)
    return spark.read.option("header", True).option("inferSchema", False).csv(paths["ranked_metrics"])


@query("run_summary")
def q_run_summary(spark, sf):
    """#5: best per entity, pooled best, model count, entities (one row, JSON included)."""
    return RN.run_summary(_run(spark, sf))


@query("comparison_report")
def q_comparison_report(spark, sf):
    """#6: fixed-width comparison report lines (section, order, line number, text)."""
    r = _run(spark, sf)
    return RN.comparison_report(r.ranked, r.combined)


@query("save_models")
def q_save_models(spark, sf):
    """#7: all eight models of each entity, trees untuned, written to one table and read back; what was stored, and how well it scores."""
    st = RN.stack_for(spark, sf)
    trees = ML.tree_models(st, ML.given_params(st, {k: {} for k in MD.TREE_MODELS}), RN.QUERY_CFG)
    coefs = MD.fit_linear_family(st.frame.filter(F.col("role") == "fit"), "entity", st.slots, "y_t")
    coefs, trees = RN.read_models(spark, RN.write_models(RN.stored_models(coefs, trees), f"{RN.output_root(spark)}/models"))
    sizes = coefs.select("entity", "model_key", F.lit(0).alias("n_nodes"), F.size("coef").alias("n_coef")).unionByName(
        trees.select("entity", "model_key", F.size("feature").alias("n_nodes"), F.lit(0).alias("n_coef")))
    stored = sizes.groupBy("entity", "model_key").agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_coef").alias("n_coef"))
    scored = M.forecast_metrics(ML.to_predictions(RN.score_models(st.frame.filter(F.col("role") == "holdout"), coefs, trees, st.slots)))
    return stored.join(scored.select("entity", "model_key", "mae"), ["entity", "model_key"])


@query("model_dashboard")
def q_model_dashboard(spark, sf):
    """#67: per (entity, model) metrics, params, series, residuals and top-12 importances."""
    return RN.model_dashboard(_run(spark, sf))


@query("attach_forecast", Q.with_ctes(*Q.PANEL_CTES, ("lastv", (
    "SELECT entity, CAST(max_by(target, period) AS DOUBLE) AS last_target FROM weekly_panel WHERE split = 'train' "
    "GROUP BY entity")), ("fc", (
    "SELECT t.entity, t.year, t.weekofyear, CAST(round_even(l.last_target, 0) AS BIGINT) AS total_cases "
    "FROM weekly_panel t JOIN lastv l ON t.entity = l.entity WHERE t.split = 'test'")),
    body=("SELECT m.entity, m.year, m.weekofyear, m.period, fc.total_cases FROM weekly_panel m LEFT JOIN fc "
          "ON m.entity = fc.entity AND m.year = fc.year AND m.weekofyear = fc.weekofyear WHERE m.split = 'test'")))
def q_attach_forecast(spark, sf):
    """#18 (+ #61): a naive last-known-count forecast put back on the submission rows by key."""
    p = P.scan_panel(spark, sf)
    last = p.filter(F.col("split") == "train").groupBy("entity").agg(
        F.max_by(F.col("target").cast("double"), "period").alias("last_target"))
    test = p.filter(F.col("split") == "test")
    fc = test.join(last, "entity").select("entity", "year", "weekofyear",
                                          rint_long("last_target").alias("total_cases"))
    meta = test.select("entity", "year", "weekofyear", "period")
    return J.attach_forecast(meta, fc, ["entity", "year", "weekofyear"])


@query("scan_daily_panel", Q.with_ctes(("daily_panel", Q.DAILY_PANEL), body=sel_sql(
    P.DAILY_FEATURES, ["entity", "period", "year", "weekofyear", "target", "split"], "daily_panel")))
def q_scan_daily_panel(spark, sf):
    """#1 on the second panel shape: event type x day from ``events`` (exact distinct users)."""
    return P.daily_panel(spark, sf)


REPORT_HEADS = [RN.report_header(RN.REPORT_COLUMNS), RN.report_header(RN.REPORT_COLUMNS[:-1])]
REPORT_ROWS = [RN.report_row(RN.REPORT_COLUMNS), RN.report_row(RN.REPORT_COLUMNS[:-1])]
REPORT_SQL = Q.with_ctes(*PRED_CTES, (
    "met2", f"SELECT entity, {DISPLAY_SQL} AS model, model_key, {Q.metric_sql(rounded=False)}, "
            "model_key IN ('decision_tree', 'random_forest', 'xgboost', 'lightgbm') AS tuned FROM preds GROUP BY ALL"), (
    "rk", f"SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mae, {MODEL_ORDER_SQL}, model_key) AS rank FROM met2"), (
    "ents", "SELECT entity, CAST(row_number() OVER (ORDER BY entity) AS INTEGER) AS section_order "
            "FROM (SELECT DISTINCT entity FROM rk) d"), (
    "pooled", f"SELECT model_key, {DISPLAY_SQL} AS model, {Q.metric_sql(rounded=False)} FROM preds GROUP BY model_key"), (
    "crk", f"SELECT *, row_number() OVER (ORDER BY mae, {MODEL_ORDER_SQL}, model_key) AS rank FROM pooled"),
    body=(
        "SELECT r.entity AS section, e.section_order, CAST(r.rank + 3 AS INTEGER) AS line_no, "
        f"printf('{REPORT_ROWS[0]}', r.rank, r.model, r.mae, r.rmse, r.r2, "
        "CASE WHEN r.tuned THEN 'True' ELSE 'False' END) AS line FROM rk r JOIN ents e USING (entity) "
        "UNION ALL SELECT entity, section_order, 0, '--- Entity: ' || upper(entity) || ' ' || "
        "repeat('-', greatest(66 - length(entity), 0)) FROM ents "
        f"UNION ALL SELECT entity, section_order, 1, '{REPORT_HEADS[0]}' FROM ents "
        f"UNION ALL SELECT entity, section_order, 2, '{'-' * len(REPORT_HEADS[0])}' FROM ents "
        "UNION ALL SELECT r.entity, e.section_order, 1000, printf('  -> Best for %s: %s (MAE=%.3f)', upper(r.entity), "
        "r.model, r.mae) FROM rk r JOIN ents e USING (entity) WHERE r.rank = 1 "
        "UNION ALL SELECT 'combined', 1000000, CAST(rank + 3 AS INTEGER), " f"printf('{REPORT_ROWS[1]}', "
        "rank, model, mae, rmse, r2) FROM crk "
        f"UNION ALL SELECT 'combined', 1000000, 0, '--- Combined (all entities pooled) {'-' * 39}' "
        f"UNION ALL SELECT 'combined', 1000000, 1, '{REPORT_HEADS[1]}' "
        f"UNION ALL SELECT 'combined', 1000000, 2, '{'-' * len(REPORT_HEADS[1])}' "
        "UNION ALL SELECT 'combined', 1000000, 1000, printf('Overall best (combined MAE): %s (MAE=%.3f)', model, mae) "
        "FROM crk WHERE rank = 1"))


@query("comparison_report_lines", REPORT_SQL)
def q_comparison_report_lines(spark, sf):
    """#6 on the ML-free predictors: the fixed-width report lines, checkable against SQL printf."""
    preds = FL.naive_predictions(spark, sf)
    metrics = M.metrics_table(M.forecast_metrics(preds))
    return RN.comparison_report(M.rank_models(metrics, "mae"), M.combined_scores(preds))
