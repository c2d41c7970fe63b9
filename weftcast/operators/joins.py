"""Joins (#15 join_labels, #16 join_key_violations, #18 attach_forecast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class JoinValidationError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (a shuffle of the key columns only)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def validate_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Raise like pandas ``validate='one_to_one'`` if either side repeats a key."""
    for side, df in (("left", left), ("right", right)):
        if duplicate_keys(df, keys).limit(1).count():
            raise JoinValidationError(f"merge keys are not unique in {side} dataset")


def _single(df: DataFrame, side: str) -> DataFrame:
    """``df`` (with ``__n``, the rows of its key): a key found more than once fails the query when it runs."""
    message = F.lit(f"merge keys are not unique in {side} dataset")
    return df.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("__n")


def join_labels(features: DataFrame, labels: DataFrame, keys: list[str],
                validate: bool | str = True) -> DataFrame:
    """Left equi-join of feature rows to labels on ``keys`` (#15).

    Feature rows without a label keep a NULL target.  NULL keys match each
    other, as in pandas: the join is on a struct of the keys, whose NULL
    fields are equal.

    ``validate=True`` raises at once if either side repeats a key, at the cost
    of two jobs.  ``validate="plan"`` starts none: the rows of a key are
    counted where the join has brought them together anyway, and the query
    fails when it runs.  Falsy: not checked.
    """
    if validate is True:
        validate_one_to_one(features, labels, keys)
    key, values = F.struct(*[F.col(k).alias(k) for k in keys]), [c for c in labels.columns if c not in keys]
    left = features.select("*", key.alias("__key"))
    right = labels.select(key.alias("__key"), *values)
    if validate == "plan":
        same = Window.partitionBy("__key")
        left = _single(left.select("*", F.count(F.lit(1)).over(same).alias("__n")), "left")
        right = _single(right.select("*", F.count(F.lit(1)).over(same).alias("__n")), "right")
    return left.join(right, "__key", "left").drop("__key")


def join_key_violations(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """#16: duplicate keys on either side, and feature rows with no label."""
    dup_f = duplicate_keys(features, keys).select(F.lit("duplicate_feature_key").alias("violation"), *keys, "n")
    dup_l = duplicate_keys(labels, keys).select(F.lit("duplicate_label_key").alias("violation"), *keys, "n")
    lab = labels.select(*[F.col(k).alias(f"__r_{k}") for k in keys])
    cond = None
    for k in keys:   # NULL-safe, like join_labels
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    unmatched = (features.select(*keys).join(lab, cond, "left_anti")
                 .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                 .select(F.lit("unlabelled_feature_row").alias("violation"), *keys, "n"))
    return dup_f.unionByName(dup_l).unionByName(unmatched)


def attach_forecast(meta: DataFrame, forecast: DataFrame, keys: list[str],
                    value_col: str = "total_cases") -> DataFrame:
    """#18: put forecasts back on the submission rows by key, not by position."""
    return meta.join(forecast.select(*keys, value_col), keys, "left")
