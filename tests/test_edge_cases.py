"""Edge rows: duplicate join keys, unlabelled rows, constant predictors, skew, histogram edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftcast.operators import eda as D
from weftcast.operators import joins as J
from weftcast.spec import PanelSpec

SPEC = PanelSpec(entity="entity", period="period", target="target", split="split")


def test_join_labels_rejects_duplicate_keys(spark):
    feats = spark.createDataFrame([("a", 2000, 1, 1.0), ("a", 2000, 2, 2.0)], "entity string, year int, weekofyear int, x double")
    labels = spark.createDataFrame([("a", 2000, 1, 5), ("a", 2000, 1, 6)], "entity string, year int, weekofyear int, target long")
    with pytest.raises(J.JoinValidationError):
        J.join_labels(feats, labels, ["entity", "year", "weekofyear"])


def test_join_labels_keeps_unlabelled_rows_and_null_keys(spark):
    feats = spark.createDataFrame([("a", 2000, 1), ("a", 2000, 53), (None, 2000, 1)], "entity string, year int, weekofyear int")
    labels = spark.createDataFrame([("a", 2000, 1, 5), (None, 2000, 1, 7)], "entity string, year int, weekofyear int, target long")
    out = {(r["entity"], r["weekofyear"]): r["target"] for r in
           J.join_labels(feats, labels, ["entity", "year", "weekofyear"]).collect()}
    assert out == {("a", 1): 5, ("a", 53): None, (None, 1): 7}
    v = J.join_key_violations(feats, labels, ["entity", "year", "weekofyear"]).collect()
    assert [(r["violation"], r["weekofyear"]) for r in v] == [("unlabelled_feature_row", 53)]


def test_constant_predictor_correlation_is_null(spark):
    rows = [("e", i, 3.0, float(i), float(i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "entity string, period int, c double, x double, target double")
    out = {(r["feature_a"], r["feature_b"]): r["corr"] for r in D.correlation_matrix(df, SPEC, ["c", "x", "target"]).collect()}
    assert out[("c", "c")] is None and out[("x", "c")] is None
    assert abs(out[("x", "x")] - 1.0) < 1e-12
    pdf = pd.DataFrame({"x": [float(i) for i in range(10)], "t": [float(i % 3) for i in range(10)]})
    assert abs(out[("target", "x")] - pdf["x"].corr(pdf["t"])) < 1e-12


def test_target_skew_matches_pandas(spark):
    y = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate(y)], "entity string, period int, target long")
    r = D.target_skew(df, SPEC).first()
    s = pd.Series(y, dtype=float)
    assert abs(r["skew_raw"] - s.skew()) < 1e-10
    assert abs(r["skew_log1p"] - np.log1p(s).skew()) < 1e-10


def test_histogram_matches_numpy_and_keeps_empty_bins(spark):
    vals = [0.0, 0.0, 1.0, 9.5, 10.0]
    df = spark.createDataFrame([("e", v) for v in vals], "entity string, v double")
    h = D.equal_width_histogram(df, ["entity"], "v", 5, density=True).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=5, density=False)
    assert [r["count"] for r in h] == list(counts)
    assert np.allclose([r["bin_lo"] for r in h], edges[:-1])
    dens, _ = np.histogram(vals, bins=5, density=True)
    assert np.allclose([r["density"] for r in h], dens)


def test_missing_counts_worst_first(spark):
    rows = [("e", "train", i, None if i < 3 else 1.0, None if i < 1 else 2.0, 3.0) for i in range(6)]
    df = spark.createDataFrame(rows, "entity string, split string, period int, a double, b double, c double")
    out = {r["feature"]: r for r in D.missing_counts(df, SPEC, ["a", "b", "c"]).collect()}
    assert out["a"]["n_missing"] == 3 and out["a"]["worst_rank"] == 1
    assert out["b"]["worst_rank"] == 2 and out["c"]["worst_rank"] is None
    assert out["c"]["total_missing"] == 4
