"""Train-only standard scaling (#17 apply_fitted_stats, #37 scaler_fit, #63 scale_features).

Population std (numpy/sklearn ``StandardScaler``), a zero std divides by 1.
Do not use ``pyspark.ml.feature.StandardScaler``: it uses the sample std.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def scaler_fit(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """One row per entity: ``{c}__mean`` and ``{c}__scale`` for every feature (one aggregation)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"),
                 F.coalesce(F.when(F.stddev_pop(x) != 0, F.stddev_pop(x)), F.lit(1.0)).alias(f"{c}__scale")]
    return df.groupBy(entity).agg(*aggs)


def scaler_long(stats: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Long view of the fitted statistics: (entity, feature, feature_idx, mean, scale)."""
    args = [F.lit(len(cols))]
    for i, c in enumerate(cols):
        args += [F.lit(c), F.lit(i), F.col(f"{c}__mean"), F.col(f"{c}__scale")]
    return stats.select(entity, F.stack(*args).alias("feature", "feature_idx", "mean", "scale"))


def apply_fitted_stats(df: DataFrame, stats: DataFrame, entity: str, cols: list[str],
                       max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(x - mean) / scale with train-fitted statistics, for any rows.

    The statistics table has one row per entity; it is broadcast only when its
    estimated size is under the bound (it grows with the number of entities),
    otherwise it is a shuffle join on entity.
    """
    st = broadcast_if_small(stats, max_broadcast_bytes)
    j = df.join(st, entity, "left")
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale")).alias(c) for c in cols])


def scale_features(df: DataFrame, entity: str, cols: list[str], fit_filter) -> tuple[DataFrame, DataFrame]:
    """Fit on the rows matching ``fit_filter`` and scale all rows; returns (scaled, stats)."""
    stats = scaler_fit(df.filter(fit_filter), entity, cols)
    return apply_fitted_stats(df, stats, entity, cols), stats
