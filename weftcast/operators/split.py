"""Temporal hold-out and expanding time-series CV folds (#47, #48)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PanelSpec


def temporal_split(df: DataFrame, spec: PanelSpec, train_frac: float = 0.75,
                   role_col: str = "role") -> DataFrame:
    """Per entity, the earliest ``floor(n * train_frac)`` rows are 'fit', the rest 'holdout'.

    ``n`` and the position come from windows over the same (entity) spec as
    the features, so no extra exchange is planned.
    """
    w = Window.partitionBy(spec.entity).orderBy(spec.period)
    n = F.count(F.lit(1)).over(Window.partitionBy(spec.entity))
    pos = F.row_number().over(w)
    cut = F.floor(n * F.lit(float(train_frac)))
    return df.select("*", F.when(pos <= cut, F.lit("fit")).otherwise(F.lit("holdout")).alias(role_col))


def timeseries_cv_folds(df: DataFrame, spec: PanelSpec, n_splits: int = 4) -> DataFrame:
    """Expanding-window folds (scikit-learn TimeSeriesSplit semantics).

    With ``t = n div (S + 1)``: fold i validates rows ``[n-(S-i)*t, n-(S-i-1)*t)``
    and trains on every earlier row.  Long form: one row per (row, fold) with a
    ``cv_role`` of 'train' or 'valid'; rows in neither are not emitted.
    """
    w = Window.partitionBy(spec.entity).orderBy(spec.period)
    n = F.count(F.lit(1)).over(Window.partitionBy(spec.entity))
    base = df.select("*", (F.row_number().over(w) - 1).alias("__pos"), n.alias("__n"))
    t = F.floor(F.col("__n") / F.lit(n_splits + 1))
    start = F.col("__n") - (F.lit(n_splits) - F.col("fold")) * t
    out = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    role = (F.when(F.col("__pos") < start, F.lit("train"))
             .when(F.col("__pos") < start + t, F.lit("valid")))
    return out.select("*", role.alias("cv_role")).filter(F.col("cv_role").isNotNull()).drop("__pos", "__n")
