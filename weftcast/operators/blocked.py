"""Skew-safe variants of the entity windows for very long series.

A plain ``Window.partitionBy(entity)`` puts each entity's whole series in one
task.  Panel rows per entity are bounded by the number of periods, which is
usually small, but an entity with a very long series (or one holding a third
of all rows) would become a straggler.  These variants give the same results
with parallelism inside an entity:

* ``row_positions``: the 0-based row index of every row within its entity,
  from per-(entity, time bucket) row numbers plus prefix offsets taken from a
  small (entity, bucket) count aggregate - no single-task window over an
  entity.
* ``blocked_window_features``: lags / trailing rolling statistics reach at
  most H rows back, so rows are cut into blocks of B >= H positions and the
  last H rows of each block are copied into the next block as a halo; the
  window runs per (entity, block) and halo rows are dropped afterwards.
* ``blocked_ffill_bfill``: forward fill is a prefix scan - a local fill per
  block, then each block's last observed value is carried across blocks over
  the small per-block aggregate; leading gaps take the first observed value of
  the (entity, split) from a per-group aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from ..spec import PanelSpec
from .features import DEFAULT_LAGS, DEFAULT_WINDOWS, lag_exprs, rolling_exprs

POS = "__pos"


def row_positions(df: DataFrame, spec: PanelSpec, bucket_days: int = 364) -> DataFrame:
    """Add ``__pos``: the row's 0-based order within its entity by period."""
    bucket = F.floor(F.unix_date(F.to_date(F.col(spec.period))) / F.lit(bucket_days))
    b = df.withColumn("__bucket", bucket)
    counts = b.groupBy(spec.entity, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(spec.entity).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(spec.entity, "__bucket", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy(spec.entity, "__bucket").orderBy(spec.period)) - 1
    return (b.join(broadcast_if_small(offsets), [spec.entity, "__bucket"])
             .select("*", (F.col("__off") + local).alias(POS)).drop("__off", "__bucket"))


def blocked_window_features(df: DataFrame, spec: PanelSpec, cols: list[str], lags=DEFAULT_LAGS,
                            windows=DEFAULT_WINDOWS, block_rows: int = 4096, positions: bool = True) -> DataFrame:
    """Same columns as ``features.window_features`` computed per (entity, block) with a halo."""
    reach = max([*lags, *windows])
    if block_rows < reach:
        raise ValueError("block_rows must be >= the longest lag / rolling window")
    d = row_positions(df, spec) if positions else df
    blk = F.floor(F.col(POS) / block_rows)
    in_halo = (F.col(POS) % block_rows) >= block_rows - reach
    tagged = d.select("*", F.explode(F.when(in_halo, F.array(blk, blk + 1)).otherwise(F.array(blk)))
                      .alias("__block"))
    tagged = tagged.withColumn("__halo", F.col("__block") != blk)
    w = Window.partitionBy(spec.entity, "__block").orderBy(POS)
    exprs = []
    for c in cols:
        exprs += lag_exprs(c, lags, w)
        exprs += rolling_exprs(c, windows, w)
    out = tagged.select("*", *exprs).filter(~F.col("__halo")).drop("__block", "__halo")
    return out.drop(POS) if positions else out


def blocked_ffill_bfill(df: DataFrame, spec: PanelSpec, cols: list[str], block_rows: int = 4096) -> DataFrame:
    """Same result as ``clean.impute_ffill_bfill`` (partition (entity, split)) without a per-entity task."""
    d = row_positions(df, spec).withColumn("__block", F.floor(F.col(POS) / block_rows))
    part = [spec.entity, spec.split]
    wl = Window.partitionBy(*part, "__block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.last(F.col(c), ignorenulls=True).over(wl).alias(f"__ff_{c}") for c in cols])
    # last observed value of each block and first observed value of each (entity, split)
    blocks = d.groupBy(*part, "__block").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"__last_{c}") for c in cols])
    wb = Window.partitionBy(*part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*part, "__block", *[F.last(F.col(f"__last_{c}"), ignorenulls=True).over(wb)
                                               .alias(f"__in_{c}") for c in cols])
    firsts = d.groupBy(*part).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"__first_{c}") for c in cols])
    j = local.join(carry, [*part, "__block"], "left").join(firsts, part, "left")
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *[F.coalesce(F.col(f"__ff_{c}"), F.col(f"__in_{c}"), F.col(f"__first_{c}")).alias(c)
                             for c in cols])
