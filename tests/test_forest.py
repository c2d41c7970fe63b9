"""Trees, forests and boosted trees against brute force; long entities, layouts, parameters, recursion and the model store."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from weftcast.operators import forest, levels
from weftcast.plans import modelling as ML
from weftcast.plans import runs as RN

WIDTH = 6
COLS = [f"s_{i}" for i in range(WIDTH)]


def sample(n=90, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, WIDTH)).round(1)
    y = np.log1p(rng.poisson(np.exp(1 + x[:, 0] * 0.6 + 0.5 * (x[:, 1] > 0)))).astype(float)
    return x, y


def frame(spark, *entities):
    rows = [(e, dt.date(2000, 1, 3) + dt.timedelta(weeks=i), float(t), *map(float, v)) for e, (x, y) in entities for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "entity string, period date, y_t double, " + ", ".join(f"{c} double" for c in COLS))


def run_one(x, y, key, params, use=None, seed=7):
    use = np.ones(len(y), np.int64) if use is None else use
    (_, forecast, trees), = forest.Unit(x, y, [(forest.rules(key, params, x.shape[1]), use)], seed).run(keep=True)
    return forecast, trees


def plain_tree(bins, g, w, rule, rows, depth=0):
    """Recursive growth over (feature, cut) in order: the first of the largest gain."""
    G, W, l1, l2 = (w * g)[rows].sum() / forest.SCALE, w[rows].sum(), rule["l1"], rule["l2"]
    left_over = lambda v: np.sign(v) * max(abs(v) - l1, 0)
    score = lambda a, b: left_over(a) ** 2 / (b + l2)
    best, found = forest.LEAST_GAIN, None
    if len(rows) >= max(rule["split"], 2 * rule["leaf"]) and depth < rule["depth"]:
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f])[:-1]:
                inside = bins[rows, f] <= b
                n, a = inside.sum(), (w * g)[rows][inside].sum() / forest.SCALE
                wl = w[rows][inside].sum()
                if min(n, len(rows) - n) < rule["leaf"] or min(wl, W - wl) < rule["weight"]:
                    continue
                gain = score(a, wl) + score(G - a, W - wl) - score(G, W)
                if gain > best + 1e-12:
                    best, found = gain, (f, b, inside)
    value = left_over(G) / (W + l2)
    if found is None:
        return value
    f, b, inside = found
    return f, b, plain_tree(bins, g, w, rule, rows[inside], depth + 1), plain_tree(bins, g, w, rule, rows[~inside], depth + 1)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("params", [{"max_depth": 1}, {"max_depth": 2}, {"max_depth": 4, "min_samples_leaf": 5}, {"min_samples_split": 20}, {}])
def test_tree_equals_brute_force(params):
    x, y = sample()
    bins = forest.binned(x, forest.cuts_of(x))
    want = plain_tree(bins, forest.whole(y), np.ones(len(y), np.int64), forest.rules("decision_tree", params, WIDTH), np.arange(len(y)))
    assert np.allclose(run_one(x, y, "decision_tree", params)[0], [walk(want, r) for r in bins], atol=1e-9)


def test_forest_is_the_mean_of_trees_of_bags():
    x, y = sample()
    rule = forest.rules("random_forest", {"n_estimators": 5, "max_depth": 3}, WIDTH)
    bins, total = forest.binned(x, forest.cuts_of(x)), np.zeros(len(y))
    for t in range(5):
        w = forest.members(rule, np.array([t]), len(y), 7)[0]
        tree = plain_tree(bins, forest.whole(y), w, rule, np.flatnonzero(w))
        total += [walk(tree, r) for r in bins]
    assert np.allclose(run_one(x, y, "random_forest", {"n_estimators": 5, "max_depth": 3})[0], total / 5, atol=1e-9)
    many = np.concatenate([forest.members(rule, np.array([t]), 1000, 7)[0] for t in range(20)])
    assert abs(many.mean() - 1) < 0.03 and abs(many.var() - 1) < 0.05


@pytest.mark.parametrize("params", [{"reg_lambda": 2.0, "reg_alpha": 1.0, "max_depth": 3}, {"subsample": 0.6, "max_depth": 2}, {"min_child_weight": 9.0}])
def test_boosting_equals_brute_force(params):
    x, y = sample()
    params = {**params, "n_estimators": 6, "learning_rate": 0.3}
    rule = forest.rules("xgboost", params, WIDTH)
    bins = forest.binned(x, forest.cuts_of(x))
    margin = np.full(len(y), forest.whole(y).sum() / forest.SCALE / len(y))
    for r in range(6):
        w = forest.members(rule, np.array([r]), len(y), 7)[0]
        tree = plain_tree(bins, forest.whole(y - margin), w, rule, np.flatnonzero(w))
        margin = margin + 0.3 * np.array([walk(tree, b) for b in bins])
    assert np.allclose(run_one(x, y, "xgboost", params)[0], margin, atol=1e-9)


def test_leaf_wise_growth_is_best_first():
    x, y = sample(200, 3)
    for leaves in (2, 5, 9):
        _, trees = run_one(x, y, "lightgbm", {"n_estimators": 1, "num_leaves": leaves, "min_child_samples": 5})
        assert trees[1][1]["feature"].count(-1) == leaves
    rule = forest.rules("lightgbm", {"min_child_samples": 5, "max_depth": -1}, WIDTH)
    bins, g = forest.binned(x, forest.cuts_of(x)), forest.whole(y - forest.whole(y).sum() / forest.SCALE / len(y))
    one = {**rule, "depth": 1}
    grown, open_ = 1, {(): np.arange(len(y))}
    gains = {}
    while grown < 9:  # split whichever leaf gains most, one at a time
        for name, rows in open_.items():
            if name not in gains:
                tree = plain_tree(bins, g, np.ones(len(y), np.int64), one, rows)
                if isinstance(tree, tuple):
                    inside = bins[rows, tree[0]] <= tree[1]
                    parts = [rows[inside], rows[~inside]]
                    gains[name] = (sum((g[p].sum() / forest.SCALE) ** 2 / len(p) for p in parts) - (g[rows].sum() / forest.SCALE) ** 2 / len(rows), parts)
        name = max(gains, key=lambda k: gains[k][0])
        open_.pop(name)
        for i, part in enumerate(gains.pop(name)[1]):
            open_[(*name, i)] = part
        grown += 1
    forecast, _ = run_one(x, y, "lightgbm", {"n_estimators": 1, "num_leaves": 9, "min_child_samples": 5, "learning_rate": 1.0})
    base = forest.whole(y).sum() / forest.SCALE / len(y)
    for rows in open_.values():
        assert np.allclose(forecast[rows], base + g[rows].sum() / forest.SCALE / len(rows), atol=1e-9)


LIVE = [("decision_tree", "min_samples_split", 2, 40), ("decision_tree", "min_samples_leaf", 1, 15), ("decision_tree", "max_depth", None, 2), ("random_forest", "max_features", 1.0, "sqrt"), ("random_forest", "n_estimators", 4, 9),
        ("xgboost", "reg_alpha", 0.0, 1.0), ("xgboost", "reg_lambda", 0.5, 9.0), ("xgboost", "subsample", 1.0, 0.6), ("xgboost", "colsample_bytree", 1.0, 0.4), ("xgboost", "min_child_weight", 1.0, 20.0), ("xgboost", "learning_rate", 0.1, 0.3),
        ("lightgbm", "num_leaves", 4, 15), ("lightgbm", "min_child_samples", 5, 25), ("lightgbm", "colsample_bytree", 1.0, 0.4), ("lightgbm", "reg_lambda", 0.0, 9.0)]


@pytest.mark.parametrize("key, name, a, b", LIVE)
def test_parameters_are_live(key, name, a, b):
    x, y = sample(150)
    few = {} if key == "decision_tree" else {"n_estimators": 8} | ({"min_child_samples": 5} if key == "lightgbm" else {})
    assert not np.array_equal(run_one(x, y, key, {**few, name: a})[0], run_one(x, y, key, {**few, name: b})[0])


def test_leafwise_row_sampling_needs_its_frequency():
    x, y = sample(150)
    of = lambda **p: run_one(x, y, "lightgbm", {"n_estimators": 8, "min_child_samples": 5, **p})[0]
    assert np.array_equal(of(), of(subsample=0.5)) and not np.array_equal(of(), of(subsample=0.5, subsample_freq=1))
    with pytest.raises(ValueError):
        forest.rules("lightgbm", {"no_such": 1}, WIDTH)


def test_draws_equal_sql(spark):
    values = [(-5, 0), (3, 17), (2 ** 62, -1)]
    got = [r.h for r in spark.createDataFrame(values, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert got == forest.draw(np.array([v[0] for v in values]), np.array([v[1] for v in values])).view(np.int64).tolist()


PARAMS = [("decision_tree", {"min_samples_leaf": 3}), ("random_forest", {"n_estimators": 3, "max_features": "sqrt"}), ("xgboost", {"n_estimators": 2, "max_depth": 2, "reg_alpha": 0.5, "subsample": 0.7, "colsample_bytree": 0.5}), ("lightgbm", {"n_estimators": 2, "num_leaves": 4, "min_child_samples": 5})]


def models_of(df):
    return sorted((r.entity, r.model_key, r.tree, r.weight, r.feature, r.threshold, [round(v, 9) for v in r.value]) for r in df.collect())


def test_layouts_give_the_same_models(spark):
    rows = frame(spark, ("a", sample()), ("b", sample(60, 1)))
    params = spark.createDataFrame([(e, k, json.dumps(p)) for e in "ab" for k, p in PARAMS], "entity string, model_key string, params string")
    made = [models_of(forest.fit_models(forest.packed_rows(rows.repartition(n), COLS, "y_t"), params, 7)) for n in (1, 4, 16)]
    assert made[0] == made[1] == made[2] and len({m[:2] for m in made[0]}) == 8


@pytest.mark.parametrize("key, params", PARAMS)
def test_long_entities_have_the_same_models(spark, key, params):
    params = {**params, "max_depth": 2}
    rows = frame(spark, ("a", sample(70)), ("b", sample(50, 1)))
    given = spark.createDataFrame([(e, key, json.dumps(params)) for e in "ab"], "entity string, model_key string, params string")
    short = forest.fit_models(forest.packed_rows(rows, COLS, "y_t"), given, 7)
    assert models_of(levels.fit_models(rows.repartition(5), COLS, "y_t", given, 7)) == models_of(short)


def test_long_entities_have_the_same_scores(spark):
    rows = frame(spark, ("a", sample(70)))
    cands = [{"max_depth": 1}, {"max_depth": 2, "min_samples_leaf": 4}]
    short = forest.cv_scores(forest.packed_rows(rows, COLS, "y_t"), "decision_tree", cands, 4, "rmse", 7, 1)
    long_ = levels.cv_scores(rows, COLS, "y_t", "decision_tree", cands, 4, "rmse", 7)
    of = lambda df: {(r.candidate, r.fold): round(r.score, 9) for r in df.collect()}
    assert of(short) == of(long_) and len(of(short)) == 8


# ------------------------------------------------------------------ runs
SMALL = ML.RunConfig(search_spaces={"decision_tree": ("grid", {"max_depth": [1, 3]}), "random_forest": ("random", {"n_estimators": [4, 6], "max_depth": [3]}),
                                    "xgboost": ("random", {"n_estimators": [4, 8], "max_depth": [2]}), "lightgbm": ("random", {"n_estimators": [4], "num_leaves": [4, 7]})}, n_iter=2)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    return RN.run_forecast(spark, SF_SMALL, True, cfg=SMALL, output_dir=root), root


def test_whole_run(spark, run):
    result, root = run
    assert result.metrics.count() == 40 and result.params.count() == 20
    assert result.params.where("cv_score is null").count() == 0
    written = spark.read.option("header", True).csv(f"{root}/submission")
    assert written.count() == result.submission.count() > 0
    total = result.importances.groupBy("entity", "model_key").agg(F.sum("importance").alias("s")).collect()
    assert len(total) == 20 and all(abs(r.s - 1) < 1e-9 or r.s == 0 for r in total)
    assert RN.model_dashboard(result).where("best_params is not null and size(top_importances) = 12").count() == 20


def test_stored_models_forecast_the_same(spark, run):
    result, root = run
    stack = RN.stack_for(spark, SF_SMALL, True, False, SMALL)
    coefs, trees = RN.read_models(spark, f"{root}/models")
    scored = ML.to_predictions(RN.score_models(stack.frame.where("role = 'holdout'"), coefs, trees, stack.slots))
    of = lambda df: sorted((r.entity, r.model_key, r.period, round(r.predicted, 9)) for r in df.collect())
    assert of(scored) == of(result.predictions)


def test_recursion_of_trees_equals_a_loop(spark, run):
    full = RN.stack_for(spark, SF_SMALL, True, True, SMALL)
    models = ML.tree_models(full, ML.given_params(full, {"xgboost": {"n_estimators": 5, "max_depth": 2}}), SMALL)
    got = {(r.entity, r.period): r.predicted for r in ML.forecast_recursive_tree(full, models).collect()}
    entity = min(e for e, _ in got)
    trees = models.where(F.col("entity") == entity).orderBy("tree").collect()
    scaler = full.scaler.where(F.col("entity") == entity).first().asDict()
    past = [float(r.target) for r in full.frame.where((F.col("entity") == entity) & (F.col("split") == "train")).orderBy("period").collect()]
    parts = ML.case_parts(full.case_names)
    for r in full.frame.where((F.col("entity") == entity) & (F.col("role") == "test")).orderBy("period").collect():
        x = [r[s] or 0.0 for s in full.slots]
        for j, name in enumerate(r.sel_names):
            if name in parts:
                x[j] = (ML.case_value(np.array(past), *parts[name]) - scaler[f"s_{j}__mean"]) / scaler[f"s_{j}__scale"]
        total = 0.0
        for t in trees:
            at = 0
            while t.feature[at] >= 0:
                at = t.left[at] if x[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.weight * t.value[at]
        past.append(max(np.expm1(total), 0.0))
        assert abs(got[entity, r.period] - past[-1]) < 1e-9


def test_too_few_rows_are_an_error(spark):
    short = ML.Stack(frame(spark, ("a", sample(3))).withColumn("role", F.lit("fit")), WIDTH, None, None, [], [])
    with pytest.raises(Exception, match="too few rows"):
        ML.tune_tree(short, "decision_tree", SMALL).collect()
