"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their counts in the two
classes, taken over all labelled training rows; a linear hinge-loss model on the
scaled indicators is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcast.session import broadcast_if_small

from .common import bounded_ids, held_out, label_rows, sigmoid
from .features import count_arrays, score_texts, shape_features

FIT_ROWS = 6000  # labelled rows that the hinge-loss model is fitted on; the counts use all
ALPHA = 1.0  # smoothing of the counts
MIN_ROWS = 3  # labelled rows that must hold a feature
COST = 1.0
EPOCHS = 30
SLOPE = 4.0  # from margins to scores


@dataclass
class QualityModel:
    ratio: np.ndarray  # log-count ratios
    weight: np.ndarray  # of the scaled indicators
    bias: float

    def margin(self, features: np.ndarray) -> float:
        x = self.ratio[features]
        return float((x * self.weight[features]).sum() / max(1e-9, np.sqrt((x * x).sum()))) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(sigmoid(SLOPE * self.margin(features)))


def log_count_ratio(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """log of (count + a) / (rows + 2a) in class 1 over the same in class 0; 0 for features of too few rows."""
    rate = (counts + ALPHA) / (docs[:, None] + 2 * ALPHA)
    return np.where(counts.sum(axis=0) >= MIN_ROWS, np.log(rate[1] / rate[0]), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: Callable[[int], np.ndarray], y: np.ndarray, dim: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost_i * hinge(y_i, w . x_i), rows given as indices and a function of their values.

    The dual is solved one row at a time: its multiplier moves to the optimum
    within [0, cost_i] and the weights follow.
    """
    w, bias, dual = np.zeros(dim), 0.0, np.zeros(len(rows))
    norm = np.array([(values(i) ** 2).sum() + 1.0 for i in range(len(rows))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = values(i)
            gradient = y[i] * (w[rows[i]] @ x + bias) - 1.0
            new = min(max(dual[i] - gradient / norm[i], 0.0), cost[i])
            if (step := new - dual[i]) != 0.0:
                dual[i] = new
                w[rows[i]] += step * y[i] * x
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """A model of ``labels.quality``, fitted without the held-out fold.

    All labelled rows make the counts; a sample of ``fit_rows`` of them, chosen
    by a hash of the id, makes the hinge-loss model, which bounds what one task
    holds. Without labelled rows, or of one class only, every text scores that
    class's side of one half (no rows: 1).
    """
    marked = label_rows(labels, "quality")
    texts = docs.select("doc_id", "text")
    counts, total = count_arrays(texts.join(broadcast_if_small(marked), "doc_id"), shape_features)
    dim = counts.shape[1]
    if total.min() == 0:
        return QualityModel(np.zeros(dim), np.zeros(dim), -1.0 if total[0] else 1.0)
    ratio = log_count_ratio(counts, total)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fit(t: pa.Table) -> pa.Table:
        of, r = shape_features(), shared.value
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
        text, label = t.column("text").to_pylist(), t.column("y").to_numpy()
        rows = [f[r[f] != 0].astype(np.int32) for f in (of(text[i] or "") for i in order)]
        scale = [1.0 / max(1e-9, np.sqrt((r[f] ** 2).sum())) for f in rows]
        y = np.where(label[order] > 0, 1.0, -1.0)
        cost = COST * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
        w, bias = dual_coordinate_descent(rows, lambda i: r[rows[i]] * scale[i], y, len(r), cost)
        return pa.table({"weight": [w.tobytes()], "bias": [bias]})

    sample = bounded_ids(marked, fit_rows)  # a proven bound: fit_rows ids
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    got = rows.groupBy(F.lit("one sample").alias("sample")).applyInArrow(fit, "weight binary, bias double").collect()
    if not got:
        return QualityModel(ratio, np.zeros(dim), 1.0)
    return QualityModel(ratio, np.frombuffer(got[0].weight), got[0].bias)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; predicted 1: score 0.5 or more.

    Null texts read as empty and get a score too; null and repeated ids keep
    their rows; no documents give no rows. Only the text makes the score; other
    columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, fit_rows))
    scored = score_texts(docs, shape_features, lambda f: model.value.score(f))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all columns."""
    model, names = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, fit_rows)), docs.columns
    at = names.index("text")

    def run(batches):
        of = shape_features()
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(of(t.as_py() or "")) >= 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
