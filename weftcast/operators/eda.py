"""Diagnostics and chart-data tables (#21, #22, #27-#32, #55, #64-#66).

The reference draws figures; here each figure's data is a DataFrame.  All
are single-pass aggregations (partial aggregation before the shuffle) over
the panel, followed by tiny reshapes of the aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import broadcast_if_small, cut_lineage
from ..spec import PanelSpec
from .accumulate import accumulated, float_rows, key_arrays


def _stack(pairs: list[tuple[str, F.Column]], name: str = "feature", value: str = "value") -> F.Column:
    args = [F.lit(len(pairs))]
    for label, col in pairs:
        args += [F.lit(label), col]
    return F.stack(*args).alias(name, value)


def missing_counts(df: DataFrame, spec: PanelSpec, cols: list[str], worst: int = 3) -> DataFrame:
    """#21: missing cells per feature per (entity, split), the total and the worst ``worst``."""
    agg = df.groupBy(spec.entity, spec.split).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    idx = {c: i for i, c in enumerate(cols)}
    long = agg.select(spec.entity, spec.split, _stack([(c, F.col(c)) for c in cols], "feature", "n_missing"))
    order = F.create_map(*[x for c, i in idx.items() for x in (F.lit(c), F.lit(i))])
    part = Window.partitionBy(spec.entity, spec.split)
    w = part.orderBy(F.col("n_missing").desc(), order[F.col("feature")])
    rank = F.row_number().over(w)
    return long.select(
        spec.entity, spec.split, "feature", "n_missing",
        F.sum("n_missing").over(part).alias("total_missing"),
        F.when((F.col("n_missing") > 0) & (rank <= worst), rank).alias("worst_rank"))


def missing_summary(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """#22: % missing per feature x (entity_split) group on raw rows, worst-first.

    The groups ``{entity}_{split}`` that become columns are those of the data
    (a small aggregate, read once).
    """
    agg = cut_lineage(df.groupBy(spec.entity, spec.split).agg(
        *[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in cols]))
    grp = F.concat_ws("_", spec.entity, spec.split).alias("grp")
    groups = [r.grp for r in agg.orderBy(spec.entity, F.col(spec.split).desc()).select(grp).collect()]
    long = agg.select(grp, _stack([(c, F.col(c)) for c in cols], "feature", "pct_missing"))
    wide = long.groupBy("feature").pivot("grp", groups).agg(F.first("pct_missing"))
    # a null beside them, as greatest() skips nulls and needs two columns
    mx = F.greatest(*[wide[f"`{g}`"] for g in groups], F.lit(None).cast("double"), F.lit(None).cast("double"))
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    w = Window.orderBy(F.col("max_pct").desc(), F.col("feature_idx"))
    out = wide.select("*", mx.alias("max_pct"), order[F.col("feature")].alias("feature_idx"))
    return out.select("*", F.row_number().over(w).alias("order")).drop("feature_idx")


def correlation_matrix(df: DataFrame, spec: PanelSpec, cols: list[str]) -> DataFrame:
    """#27: pairwise-complete Pearson r per entity, lower triangle incl. the diagonal.

    ``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI; the
    guarded ratio returns NULL (pandas: NaN).  One aggregation computes all
    p(p+1)/2 pairs.
    """
    pairs, aggs = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[: i + 1]):
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            num = F.covar_pop(xa, xb)
            den = F.stddev_pop(F.when(both, xa)) * F.stddev_pop(F.when(both, xb))
            name = f"c{i}_{j}"
            aggs.append(F.try_divide(num, den).alias(name))
            pairs.append((i, j, a, b, name))
    agg = df.groupBy(spec.entity).agg(*aggs)
    args = [F.lit(len(pairs))]
    for i, j, a, b, name in pairs:
        args += [F.lit(a), F.lit(b), F.lit(i), F.lit(j), F.col(name)]
    return agg.select(spec.entity, F.stack(*args).alias("feature_a", "feature_b", "idx_a", "idx_b", "corr"))


def target_skew(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """#28: bias-corrected skew (G1) of the target, raw and log1p, per entity.

    Spark's ``skewness`` is the population g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    """
    y = F.col(spec.target).cast("double")
    n = F.count(y)
    corr = F.sqrt(n * (n - 1)) / (n - 2)
    return df.groupBy(spec.entity).agg(
        n.alias("n"),
        F.when(n > 2, F.skewness(y) * corr).alias("skew_raw"),
        F.when(n > 2, F.skewness(F.log1p(y)) * corr).alias("skew_log1p"))


def equal_width_histogram(values: DataFrame, group_cols: list[str], value_col: str, bins: int,
                          density: bool = True) -> DataFrame:
    """Equal-width histogram per group, numpy edges (last bin closed), empty bins kept.

    Bin of x: ``least(floor((x - lo) / width) + 1, bins)``; a constant group
    uses the range (x - 0.5, x + 0.5) like numpy.
    """
    v = values.select(*group_cols, F.col(value_col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    stats = v.groupBy(*group_cols).agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count("x").alias("n"))
    stats = stats.select(*group_cols, "n",
                         F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5).alias("lo"),
                         F.when(F.col("mx") > F.col("mn"), (F.col("mx") - F.col("mn")) / bins)
                          .otherwise(F.lit(1.0 / bins)).alias("width"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")) + 1, F.lit(bins)).cast("int")
    counts = (v.join(stats, group_cols).groupBy(*group_cols, b.alias("bin"))
               .agg(F.count(F.lit(1)).alias("count")))
    grid = stats.select(*group_cols, "n", "lo", "width", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    out = grid.join(counts, [*group_cols, "bin"], "left").select(
        *group_cols, "bin",
        (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        F.col("n"), F.col("width"))
    if density:
        out = out.select("*", (F.col("count") / (F.col("n") * F.col("width"))).alias("density"))
    return out.drop("n", "width")


def target_histogram(df: DataFrame, spec: PanelSpec, bins: int = 40) -> DataFrame:
    """#29: 40-bin density histograms of the target, raw and log1p, per entity."""
    y = F.col(spec.target).cast("double")
    long = df.select(spec.entity, F.explode(F.array(
        F.struct(F.lit("raw").alias("scale"), y.alias("v")),
        F.struct(F.lit("log1p").alias("scale"), F.log1p(y).alias("v")))).alias("s"))
    long = long.select(spec.entity, "s.scale", "s.v")
    return equal_width_histogram(long, [spec.entity, "scale"], "v", bins, density=True)


def residual_histogram(preds: DataFrame, bins: int = 30, group=("entity", "model_key")) -> DataFrame:
    """#30: residual histogram (counts) with the mean residual per (entity, model)."""
    r = preds.select(*group, (F.col("actual") - F.col("predicted")).alias("residual"))
    h = equal_width_histogram(r, list(group), "residual", bins, density=False)
    m = r.groupBy(*group).agg(F.avg("residual").alias("mean_residual"))
    return h.join(m, list(group))


def residual_kde(preds: DataFrame, gridsize: int = 200, group=("entity", "model_key")) -> DataFrame:
    """#31: Gaussian KDE of residuals on a grid over [min, max] (Scott bandwidth).

    h = n^(-1/5) * sample std.  Each task adds the kernels of its residuals up
    in one array over the group's grid, so a group leaves it as one row: no row
    is made for a residual and a grid point.  Null residuals are left out;
    groups without a spread (one residual, or all equal) have NULL densities.
    """
    keys = list(group)
    r = preds.select(*keys, (F.col("actual") - F.col("predicted")).cast("double").alias("residual")).where("residual is not null")
    st = r.groupBy(*keys).agg(F.min("residual").alias("mn"), F.max("residual").alias("mx"),
                              F.count("residual").alias("n"), F.stddev_samp("residual").alias("sd"))
    st = st.select(*keys, "mn", "mx", "n", (F.pow(F.col("n").cast("double"), -0.2) * F.col("sd")).alias("h"))
    st = st.select(*[F.col(k).alias(f"st_{k}") for k in keys], "mn", "mx", "n", "h")
    same = F.lit(True)  # null keys are a group as well
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"st_{k}"))
    facts = [*keys, "mn", "mx", "n", "h"]
    rows = r.join(broadcast_if_small(st), same).select(*facts, "residual")
    schema = StructType([*[rows.schema[k] for k in facts], StructField("kernels", ArrayType(DoubleType()))])
    steps = np.arange(gridsize, dtype=np.float64)

    def kernels(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        low, high, h = (batch.column(c)[int(at[0])].as_py() for c in ("mn", "mx", "h"))
        total = np.zeros(gridsize)
        if not h:
            return total
        x, values = low + (high - low) * steps / (gridsize - 1), batch.column("residual").to_numpy()[at]
        for i in range(0, len(values), 4096):
            u = (x[:, None] - values[i:i + 4096]) / h
            total += np.exp(-0.5 * u * u).sum(axis=1)
        return total

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, states, types in accumulated(batches, facts, kernels, np.add, gridsize):
            yield pa.RecordBatch.from_arrays([*key_arrays(found, types), float_rows(states)], [*facts, "kernels"])

    x = F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("grid_idx") / (gridsize - 1)
    sums = (rows.mapInArrow(added, schema).select(*facts, F.posexplode("kernels").alias("grid_idx", "kernel"))
                .groupBy(*facts, "grid_idx").agg(F.sum("kernel").alias("ksum")))
    return sums.select(*keys, "grid_idx", x.alias("x"), F.try_divide(
        F.col("ksum"), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))).alias("density"))


def scatter_limits(preds: DataFrame, group=("entity", "model_key")) -> DataFrame:
    """#32: square axis bound max(actual, predicted) * 1.05 + 1."""
    return preds.groupBy(*group).agg(
        (F.greatest(F.max("actual"), F.max("predicted")) * 1.05 + 1).alias("axis_max"))


def actual_vs_predicted(preds: DataFrame, metrics: DataFrame) -> DataFrame:
    """#64: the ordered hold-out series annotated with its metrics."""
    return preds.join(metrics.select("entity", "model_key", "mae", "rmse", "r2"), ["entity", "model_key"])


def timeline_model_order(metrics: DataFrame) -> DataFrame:
    """#55: models ordered by MAE within each entity (overlay order)."""
    w = Window.partitionBy("entity").orderBy(F.col("mae"), F.col("model_key"))
    return metrics.select("entity", "model_key", "mae", F.row_number().over(w).alias("overlay_order"))


def all_models_timeline(preds: DataFrame, model_keys: list[str]) -> DataFrame:
    """#65: period x model wide table plus the actual series."""
    return (preds.groupBy("entity", "period").pivot("model_key", model_keys)
                 .agg(F.first("predicted"))
                 .join(preds.groupBy("entity", "period").agg(F.first("actual").alias("actual")),
                       ["entity", "period"]))


def target_overview(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """#66: the target series per entity with its raw/log1p skew attached."""
    sk = target_skew(df, spec)
    y = F.col(spec.target).cast("double")
    return df.select(spec.entity, spec.period, y.alias("target"), F.log1p(y).alias("target_log1p")) \
             .join(sk, spec.entity)
