"""Linear estimators (#68-#71), per entity, and the names of all eight.

Linear family (OLS, ridge, lasso, elastic net)
    Fitted from centred moments (``accumulate.centred_moments``): tasks
    measure their rows of each entity and the parts are merged, so a hot entity
    holding a third of all rows is combined before the shuffle and raw rows
    never meet in one task.  Each entity's p x p system is then solved on
    that *aggregate* (one row per entity): closed form for OLS / ridge,
    covariance-update coordinate descent for lasso / elastic net
    (scikit-learn objectives).

The tree family is in ``forest``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..session import broadcast_if_small
from .accumulate import centred_moments, float_rows, moment_columns

# The keys of the eight models.
LINEAR_MODELS = ["linear_regression", "ridge", "lasso", "elastic_net"]
TREE_MODELS = ["decision_tree", "random_forest", "xgboost", "lightgbm"]
ALL_MODELS = LINEAR_MODELS + TREE_MODELS

# The reference's untuned linear hyper-parameters.
LINEAR_PARAMS = {
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 0.01, "max_iter": 50000},
    "elastic_net": {"alpha": 0.01, "l1_ratio": 0.5, "max_iter": 50000},
}


def is_tunable(key: str) -> bool:
    return key in TREE_MODELS


# --------------------------------------------------------------------------- #
# linear family from sufficient statistics
# --------------------------------------------------------------------------- #
def gram_statistics(df: DataFrame, keys: list[str], cols: list[str], y: str) -> DataFrame:
    """One row per key with the centred moments of ``cols`` and ``y`` (one pass, merged).

    A missing predictor counts 0, its training mean on the scaled axis, as in
    scoring; rows without a target are left out.
    """
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(cols)]
    rows = df.select(*keys, *xs, F.col(y).cast("double").alias("x_y"))
    return centred_moments(rows, keys, [*[f"x_{i}" for i in range(len(cols))], "x_y"])


def _soft(v: float, t: float) -> float:
    return math.copysign(max(abs(v) - t, 0.0), v)


def coordinate_descent(C: np.ndarray, c: np.ndarray, l1: float, l2: float,
                       max_iter: int = 50000, tol: float = 1e-12) -> np.ndarray:
    """min_w 1/2 w^T C w - c^T w + l1 |w|_1 + l2/2 |w|^2 (covariance form of the
    scikit-learn Lasso / ElasticNet objectives on centred data)."""
    p = len(c)
    w = np.zeros(p)
    diag = np.diag(C).copy()
    for _ in range(max_iter):
        max_step = 0.0
        for j in range(p):
            if diag[j] + l2 <= 0:
                continue
            r = c[j] - C[j] @ w + C[j, j] * w[j]
            new = _soft(r, l1) / (diag[j] + l2)
            max_step = max(max_step, abs(new - w[j]))
            w[j] = new
        if max_step < tol:
            break
    return w


def solve_linear(moments: np.ndarray, model: str, params: dict) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of one linear model from centred moments, the target's last."""
    p = moment_columns(moments) - 1
    n, mean, cross = moments[0], moments[1:p + 2], moments[p + 2:].reshape(p + 1, p + 1)
    C, c = cross[:p, :p] / n, cross[:p, p] / n
    if model == "linear_regression":
        w = np.linalg.lstsq(C, c, rcond=None)[0]
    elif model == "ridge":
        a = params.get("alpha", 1.0)
        w = np.linalg.solve(n * C + a * np.eye(p), n * c)
    elif model == "lasso":
        w = coordinate_descent(C, c, params.get("alpha", 0.01), 0.0, params.get("max_iter", 50000))
    elif model == "elastic_net":
        a, r = params.get("alpha", 0.01), params.get("l1_ratio", 0.5)
        w = coordinate_descent(C, c, a * r, a * (1.0 - r), params.get("max_iter", 50000))
    else:
        raise KeyError(model)
    return float(mean[p] - mean[:p] @ w), w


def fit_linear_family(df: DataFrame, entity: str, cols: list[str], y: str,
                      models=tuple(LINEAR_MODELS), params: dict | None = None,
                      group_cols: tuple = ()) -> DataFrame:
    """Coefficients (group..., entity, model_key, intercept, coef[]) for each linear model.

    ``group_cols`` fits independent models per extra key too (e.g. a CV fold),
    still from one aggregation.
    """
    params = {**LINEAR_PARAMS, **(params or {})}
    keys, models = [*group_cols, entity], list(models)
    stats = gram_statistics(df, keys, cols, y)
    schema = StructType([*[stats.schema[k] for k in keys], StructField("model_key", StringType()),
                         StructField("intercept", DoubleType()), StructField("coef", ArrayType(DoubleType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                moments = one.column("moments").flatten().to_numpy()
                solved = [solve_linear(moments, m, params.get(m, {})) for m in models]
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(k).take(pa.array([0] * len(models))) for k in keys], pa.array(models, pa.string()),
                     pa.array([b for b, _ in solved]), float_rows([w for _, w in solved])],
                    [*keys, "model_key", "intercept", "coef"])

    return stats.mapInArrow(solve, schema)


def predict_linear(df: DataFrame, coefs: DataFrame, entity: str, cols: list[str],
                   out: str = "predicted_t", group_cols: tuple = ()) -> DataFrame:
    """intercept + coef . x for every model of the entity (coefficient table broadcast if small)."""
    c = broadcast_if_small(coefs)
    j = df.join(c, [*group_cols, entity])
    # a predictor missing in a whole test block stays NULL after the fills: it
    # contributes its training mean (0 on the scaled axis) instead of voiding the row
    dot = F.aggregate(F.zip_with(F.col("coef"), F.array(*[F.coalesce(F.col(x).cast("double"), F.lit(0.0))
                                                          for x in cols]),
                                 lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return j.select(*[c for c in df.columns], "model_key", (F.col("intercept") + dot).alias(out))
