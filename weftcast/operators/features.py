"""Causal panel features (#41-#46, #56, #58).

All lag and rolling expressions share ONE window spec (entity, ordered by
period) and are emitted in ONE ``select``, so the plan has one Window node
(not a ``withColumn`` chain).  Frames are ROWS frames: the reference's
``shift``/``rolling`` count rows, not calendar time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seasonality_columns
from ..spec import PanelSpec, feature_columns
from .clean import bfill_leading_expr, ffill_expr

DEFAULT_LAGS = (1, 2, 3, 4)
DEFAULT_WINDOWS = (4, 8, 12)


def min_periods(window: int) -> int:
    return max(2, window // 2)


def panel_window(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(spec.period)


def lag_exprs(col: str, lags, w) -> list:
    return [F.lag(F.col(col), k).over(w).alias(f"{col}_lag_{k}") for k in lags]


def rolling_exprs(col: str, windows, w, stats=("mean", "std")) -> list:
    """Trailing mean / sample std over the ``win`` rows BEFORE the current one."""
    out = []
    for win in windows:
        f = w.rowsBetween(-win, -1)
        enough = F.count(F.col(col)).over(f) >= min_periods(win)
        if "mean" in stats:
            out.append(F.when(enough, F.avg(F.col(col)).over(f)).alias(f"{col}_rollmean_{win}"))
        if "std" in stats:
            out.append(F.when(enough, F.stddev_samp(F.col(col)).over(f)).alias(f"{col}_rollstd_{win}"))
    return out


def union_train_test(train: DataFrame, test: DataFrame, spec: PanelSpec) -> DataFrame:
    """#56: tag the split, give test a NULL target, concatenate by name."""
    tr = train.withColumn(spec.split, F.lit("train"))
    te = test.withColumn(spec.split, F.lit("test"))
    if spec.target not in te.columns:
        te = te.withColumn(spec.target, F.lit(None).cast(tr.schema[spec.target].dataType))
    return tr.unionByName(te, allowMissingColumns=True)


def add_seasonality(df: DataFrame, spec: PanelSpec, weekofyear_col: str | None = "weekofyear") -> DataFrame:
    """#58: woy_sin/cos over 52 weeks and month_sin/cos over 12 months."""
    woy = weekofyear_col if weekofyear_col in df.columns else None
    return df.select("*", *seasonality_columns(spec.period, woy))


def lag_features(df: DataFrame, spec: PanelSpec, cols: list[str], lags=DEFAULT_LAGS) -> DataFrame:
    """#41: ``{col}_lag_{k}``, partitioned by entity only (test inherits train's tail)."""
    w = panel_window(spec)
    return df.select("*", *[e for c in cols for e in lag_exprs(c, lags, w)])


def rolling_mean(df: DataFrame, spec: PanelSpec, cols: list[str], windows=DEFAULT_WINDOWS) -> DataFrame:
    """#42: trailing mean, min observations ``max(2, w // 2)``."""
    w = panel_window(spec)
    return df.select("*", *[e for c in cols for e in rolling_exprs(c, windows, w, ("mean",))])


def rolling_std(df: DataFrame, spec: PanelSpec, cols: list[str], windows=DEFAULT_WINDOWS) -> DataFrame:
    """#43: trailing sample std over the same frame."""
    w = panel_window(spec)
    return df.select("*", *[e for c in cols for e in rolling_exprs(c, windows, w, ("std",))])


def window_features(df: DataFrame, spec: PanelSpec, cols: list[str], lags=DEFAULT_LAGS,
                    windows=DEFAULT_WINDOWS) -> DataFrame:
    """Lags then rolling mean/std for each column, in the reference's column order."""
    w = panel_window(spec)
    exprs = []
    for c in cols:
        exprs += lag_exprs(c, lags, w)
        exprs += rolling_exprs(c, windows, w)
    return df.select("*", *exprs)


def drop_undefined_lags(df: DataFrame, spec: PanelSpec, feature_cols: list[str]) -> DataFrame:
    """#12: drop TRAIN rows with any NULL engineered feature; test rows never."""
    defined = F.lit(True)
    for c in feature_cols:
        defined = defined & F.col(c).isNotNull()
    return df.filter((F.col(spec.split) == "test") | defined)


def test_residual_fill(df: DataFrame, spec: PanelSpec, feature_cols: list[str]) -> DataFrame:
    """#46: ffill -> bfill feature NULLs inside the test block only."""
    w = Window.partitionBy(spec.entity, spec.split).orderBy(spec.period)
    is_test = F.col(spec.split) == "test"
    fc = set(feature_cols)
    return df.select(*[
        F.when(is_test, F.coalesce(ffill_expr(c, w), bfill_leading_expr(c, w))).otherwise(F.col(c)).alias(c)
        if c in fc else F.col(c) for c in df.columns])


def case_features(df: DataFrame, spec: PanelSpec, lags=DEFAULT_LAGS, windows=(4,)) -> tuple[DataFrame, list[str]]:
    """#44/#45 autoregressive case features.

    Computed over the train rows that survived :func:`drop_undefined_lags`,
    then rows with undefined case features are dropped as well; test rows get
    NULL placeholders (filled by the recursive forecast).
    """
    w = panel_window(spec)
    train = df.filter(F.col(spec.split) == "train")
    y = F.col(spec.target).cast("double")
    names, exprs = [], []
    for k in lags:
        names.append(f"cases_lag_{k}")
        exprs.append(F.lag(y, k).over(w).alias(names[-1]))
    for win in windows:
        f = w.rowsBetween(-win, -1)
        names.append(f"cases_rollmean_{win}")
        exprs.append(F.when(F.count(y).over(f) >= 2, F.avg(y).over(f)).alias(names[-1]))
    tr = train.select("*", *exprs)
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    tr = tr.filter(ok)
    te = df.filter(F.col(spec.split) == "test").select(
        "*", *[F.lit(None).cast("double").alias(n) for n in names])
    return tr.unionByName(te), names


def engineer(df: DataFrame, spec: PanelSpec, lags=DEFAULT_LAGS, windows=DEFAULT_WINDOWS,
             seasonality: bool = True, autoregressive: bool = False,
             case_lags=DEFAULT_LAGS, case_windows=(4,),
             block_rows: int | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Full feature build on a cleaned panel.

    Returns (frame, feature_names, case_feature_names).  Feature order follows
    the reference: base predictors, seasonality, then per predictor its lags
    and rolling mean/std per window, then (AR) case features.  With
    ``block_rows`` the windows run per (entity, row block) with a halo
    (``operators.blocked``) - same result, parallel inside long entities.
    """
    base = feature_columns(df, spec)
    if seasonality:
        df = add_seasonality(df, spec)
    if block_rows:
        from .blocked import blocked_ffill_bfill, blocked_window_features
        df = blocked_window_features(df, spec, base, lags, windows, block_rows)
    else:
        df = window_features(df, spec, base, lags, windows)
    names = [c for c in df.columns if c not in spec.non_features()]
    df = drop_undefined_lags(df, spec, names)
    if block_rows:
        test = blocked_ffill_bfill(df.filter(F.col(spec.split) == "test"), spec, names, block_rows)
        df = df.filter(F.col(spec.split) == "train").unionByName(test.select(*df.columns))
    else:
        df = test_residual_fill(df, spec, names)
    case_names: list[str] = []
    if autoregressive:
        df, case_names = case_features(df, spec, case_lags, case_windows)
    return df, names + case_names, case_names
