"""Linear family from Gram statistics vs direct numpy solutions; grid parameters."""

import numpy as np

from weftcast.operators import forest
from weftcast.operators import models as MD
from weftcast.plans import modelling as ML


def _data(n=120, p=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    y = 1.5 + X @ rng.normal(size=p) + rng.normal(scale=0.5, size=n)
    return X, y


def _fit_spark(spark, X, y, models):
    rows = [("e", *map(float, x), float(t)) for x, t in zip(X, y)]
    cols = [f"x{i}" for i in range(X.shape[1])]
    df = spark.createDataFrame(rows, ["entity", *cols, "y"])
    return {r["model_key"]: (r["intercept"], np.array(r["coef"]))
            for r in MD.fit_linear_family(df, "entity", cols, "y", models).collect()}


def test_ols_and_ridge_match_closed_form(spark):
    X, y = _data()
    got = _fit_spark(spark, X, y, ["linear_regression", "ridge"])
    A = np.c_[np.ones(len(y)), X]
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(got["linear_regression"][0], beta[0]) and np.allclose(got["linear_regression"][1], beta[1:])
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(X.shape[1]), Xc.T @ yc)
    assert np.allclose(got["ridge"][1], w) and np.allclose(got["ridge"][0], y.mean() - X.mean(0) @ w)


def test_lasso_and_elastic_net_satisfy_kkt(spark):
    X, y = _data(p=8, seed=1)
    got = _fit_spark(spark, X, y, ["lasso", "elastic_net"])
    n = len(y)
    Xc, yc = X - X.mean(0), y - y.mean()
    for key, l1, l2 in (("lasso", 0.01, 0.0), ("elastic_net", 0.005, 0.005)):
        w = got[key][1]
        grad = Xc.T @ (yc - Xc @ w) / n - l2 * w
        for j in range(len(w)):
            if abs(w[j]) > 1e-10:
                assert abs(grad[j] - l1 * np.sign(w[j])) < 1e-8
            else:
                assert abs(grad[j]) <= l1 + 1e-8


def test_model_groups_fit_independently(spark):
    X, y = _data(n=60, p=2, seed=2)
    rows = [(str(i % 2), i % 3, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, ["entity", "fold", "x0", "x1", "y"])
    co = MD.fit_linear_family(df, "entity", ["x0", "x1"], "y", ["linear_regression"], group_cols=("fold",))
    assert co.count() == 6


def test_grid_and_random_candidates():
    kind, space = ML.SEARCH_SPACES["decision_tree"]
    assert kind == "grid" and len(ML.grid_candidates(space)) == 72
    kind, space = ML.SEARCH_SPACES["random_forest"]
    c1 = ML.random_candidates(space, 40, 42)
    assert len(c1) == 40 and len({tuple(sorted(c.items(), key=str)) for c in c1}) == 40
    assert c1 == ML.random_candidates(space, 40, 42)


def test_only_tree_models_are_tunable():
    assert len(MD.ALL_MODELS) == 8
    assert all(not MD.is_tunable(k) for k in MD.LINEAR_MODELS)
    assert all(MD.is_tunable(k) for k in MD.TREE_MODELS)
    for k in MD.TREE_MODELS:
        assert forest.rules(k, {}, 30)["key"] == k
