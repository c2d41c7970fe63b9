"""Model stack, training, tuning and forecasting (#77-#85).

The reference's per-city loop becomes one entity-partitioned DataFrame:

    engineered panel -> 75 % split -> MI selection (fit rows) -> slot matrix
    (the k selected features of each entity in fitted order) -> train-only
    scaling -> log1p target -> fit / tune -> hold-out predictions -> expm1 and
    clip -> metrics, ranks, pooled scores, best model -> refit on all train
    rows -> direct or recursive forecast of the test rows.

Linear models for every entity come from one aggregation (``models.fit_linear_family``).
Trees, forests and boosted trees are grown by ``forest``: a search is one job over
units of an entity with a block of candidates, a fit one job over all entities.
Parameters, models and the choice of the best stay DataFrames.
"""

from __future__ import annotations

import itertools
import json
import random
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expm1_clip, log1p_target, rint_long
from ..operators import forest, levels
from ..operators import models as MD
from ..operators import scale as SC
from ..operators import select as SEL
from ..operators.split import temporal_split
from ..session import broadcast_if_small, cut_lineage
from ..sources.panels import PANEL_SPEC

SPEC = PANEL_SPEC

# The reference's search spaces (grid for the tree, random
# search with 40 samples for the ensembles), CV with 4 expanding folds.
SEARCH_SPACES = {
    "decision_tree": ("grid", {
        "max_depth": [3, 5, 7, 10, 15, None],
        "min_samples_leaf": [1, 5, 10, 20],
        "min_samples_split": [2, 10, 20]}),
    "random_forest": ("random", {
        "n_estimators": [200, 300, 500, 800],
        "max_depth": [5, 10, 15, 20, None],
        "min_samples_leaf": [1, 2, 5, 10],
        "max_features": ["sqrt", "log2", 0.5, 1.0]}),
    "xgboost": ("random", {
        "n_estimators": [200, 400, 600, 800],
        "max_depth": [3, 4, 5, 6, 8],
        "learning_rate": [0.01, 0.03, 0.05, 0.1],
        "subsample": [0.6, 0.8, 1.0],
        "colsample_bytree": [0.6, 0.8, 1.0],
        "reg_alpha": [0.0, 0.1, 1.0],
        "reg_lambda": [0.5, 1.0, 2.0]}),
    "lightgbm": ("random", {
        "n_estimators": [200, 400, 600, 800],
        "num_leaves": [15, 31, 63, 127],
        "max_depth": [-1, 4, 6, 8, 12],
        "learning_rate": [0.01, 0.03, 0.05, 0.1],
        "subsample": [0.6, 0.8, 1.0],
        "colsample_bytree": [0.6, 0.8, 1.0],
        "min_child_samples": [5, 10, 20, 30]}),
}
N_ITER = 40
N_SPLITS = 4
SEED = 42


@dataclass
class RunConfig:
    train_frac: float = 0.75
    k: int = 30
    selection: bool = True
    n_splits: int = N_SPLITS
    n_iter: int = N_ITER
    objective: str = "mae"
    seed: int = SEED
    search_spaces: dict = field(default_factory=lambda: dict(SEARCH_SPACES))
    block: int = 5  # candidates that one unit of work fits


# --------------------------------------------------------------------------- #
# candidates
# --------------------------------------------------------------------------- #
def grid_candidates(space: dict) -> list[dict]:
    """Exhaustive grid in scikit-learn ParameterGrid order (sorted keys)."""
    keys = sorted(space)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]


def random_candidates(space: dict, n_iter: int, seed: int) -> list[dict]:
    """``n_iter`` distinct grid points drawn with a seeded sampler (without replacement)."""
    grid = grid_candidates(space)
    idx = random.Random(seed).sample(range(len(grid)), min(n_iter, len(grid)))
    return [grid[i] for i in idx]


def candidates_for(key: str, cfg: RunConfig) -> tuple[str, list[dict]]:
    kind, space = cfg.search_spaces[key]
    return kind, (grid_candidates(space) if kind == "grid" else random_candidates(space, cfg.n_iter, cfg.seed))


# --------------------------------------------------------------------------- #
# stack: selection -> slots -> scaling
# --------------------------------------------------------------------------- #
def slot_columns(k: int) -> list[str]:
    return [f"s_{j}" for j in range(k)]


def slot_matrix(rows: DataFrame, selection: DataFrame, names: list[str], k: int) -> DataFrame:
    """Each entity's selected features, in fitted (original column) order, as s_0..s_{k-1}."""
    sel = (selection.filter(F.col("selected")).groupBy("entity")
           .agg(F.array_sort(F.collect_list(F.struct("sel_order", "feature_idx"))).alias("sl"))
           .select("entity", F.transform("sl", lambda s: s["feature_idx"]).alias("sel_idx"),
                   F.transform("sl", lambda s: F.element_at(F.array(*[F.lit(n) for n in names]), s["feature_idx"] + 1))
                   .alias("sel_names")))
    j = rows.join(broadcast_if_small(sel), "entity")
    allf = F.array(*[F.col(n).cast("double") for n in names])
    slots = [F.element_at(allf, F.col("sel_idx")[i] + 1).alias(s) for i, s in enumerate(slot_columns(k))]
    keep = [c for c in rows.columns if c not in names]
    return j.select(*keep, "sel_names", *slots)


@dataclass
class Stack:
    frame: DataFrame          # entity, period, ..., role, y_t, s_0.. (scaled)
    k: int
    selection: DataFrame      # entity, feature, feature_idx, mi, selected, sel_order
    scaler: DataFrame         # one row per entity, s_j__mean / s_j__scale
    names: list[str]
    case_names: list[str]

    @property
    def slots(self) -> list[str]:
        return slot_columns(self.k)


def build_stack(eng: DataFrame, names: list[str], case_names: list[str], cfg: RunConfig,
                full_train: bool = False) -> Stack:
    """Selection and scaling fitted on the 'fit' rows (or all train rows when ``full_train``)."""
    train = eng.filter(F.col("split") == "train")
    spl = temporal_split(train, SPEC, cfg.train_frac)
    if full_train:
        spl = spl.withColumn("role", F.lit("fit"))
    test = eng.filter(F.col("split") == "test").withColumn("role", F.lit("test"))
    rows = cut_lineage(spl.unionByName(test).withColumn("y_t", log1p_target("target")))
    fit = rows.filter(F.col("role") == "fit")
    k = min(cfg.k, len(names)) if cfg.selection else len(names)
    scores = SEL.mutual_info_ksg(fit.select("entity", "period", "y_t", *names), "entity", "period", "y_t", names)
    selection = cut_lineage(SEL.select_top_k(scores, "entity", k, enabled=cfg.selection))
    slots = slot_matrix(rows, selection, names, k)
    stats = SC.scaler_fit(slots.filter(F.col("role") == "fit"), "entity", slot_columns(k))
    scaled = SC.apply_fitted_stats(slots, stats, "entity", slot_columns(k))
    return Stack(cut_lineage(scaled), k, selection, cut_lineage(stats), names, case_names)


# --------------------------------------------------------------------------- #
# fitting and prediction
# --------------------------------------------------------------------------- #
def linear_predictions(stack: Stack, keys=tuple(MD.LINEAR_MODELS), fit_role: str = "fit",
                       pred_role: str = "holdout") -> DataFrame:
    """All linear models, all entities: one aggregation, one solve per entity, one scoring pass."""
    fr = stack.frame
    coefs = MD.fit_linear_family(fr.filter(F.col("role") == fit_role), "entity", stack.slots, "y_t", keys)
    pred = MD.predict_linear(fr.filter(F.col("role") == pred_role), coefs, "entity", stack.slots)
    return pred


def fit_rows(stack: Stack, fit_role: str, entities: DataFrame | None) -> DataFrame:
    """The stack's rows of a role, of all entities or of those of ``entities`` (entity)."""
    rows = stack.frame.filter(F.col("role") == fit_role)
    return rows if entities is None else rows.join(broadcast_if_small(entities.select("entity")), "entity", "left_semi")


def long_rows(rows: DataFrame) -> DataFrame | None:
    """The rows of entities too long for one task; None if there is none."""
    found = cut_lineage(levels.long_entities(rows, forest.TASK_ROWS))
    return rows.join(broadcast_if_small(found.select("entity")), "entity", "left_semi") if found.take(1) else None


def tune_tree(stack: Stack, key: str, cfg: RunConfig, candidates: list[dict] | None = None,
              fit_role: str = "fit", entities: DataFrame | None = None) -> DataFrame:
    """#77/#78/#79: time-series CV of every candidate, per entity; (entity, model_key, params, cv_score) of the best.

    params is JSON. The candidate of the smallest mean fold score is the best,
    the first of ties. An entity of too few rows for the folds is an error.
    """
    cands = candidates_for(key, cfg)[1] if candidates is None else candidates
    rows = fit_rows(stack, fit_role, entities)
    scores = forest.cv_scores(cut_lineage(forest.packed_rows(rows, stack.slots, "y_t")), key, cands, cfg.n_splits, cfg.objective, cfg.seed, cfg.block)
    if (of_long := long_rows(rows)) is not None:
        scores = scores.unionByName(levels.cv_scores(of_long, stack.slots, "y_t", key, cands, cfg.n_splits, cfg.objective, cfg.seed))
    mean = scores.groupBy("entity", "candidate").agg(F.avg("score").alias("cv_score"))
    best = mean.groupBy("entity").agg(F.min(F.struct("cv_score", "candidate")).alias("b"))
    listed = stack.frame.sparkSession.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cands)], "candidate int, params string")
    too_few = F.raise_error(F.concat(F.lit("no cross-validation score, too few rows: entity "), F.col("entity")))
    score = F.when(F.isnan("b.cv_score"), too_few.cast("double")).otherwise(F.col("b.cv_score"))
    best = best.select("entity", F.lit(key).alias("model_key"), F.col("b.candidate").alias("candidate"), score.alias("cv_score"))
    return cut_lineage(best.join(F.broadcast(listed), "candidate").select("entity", "model_key", "params", "cv_score"))  # one row for each candidate


def given_params(stack: Stack, params: dict[str, dict], entities: DataFrame | None = None) -> DataFrame:
    """(entity, model_key, params, cv_score) with the same parameters for all entities, untuned."""
    spark = stack.frame.sparkSession
    listed = spark.createDataFrame([(k, json.dumps(p)) for k, p in params.items()], "model_key string, params string")
    ents = (stack.frame if entities is None else entities).select("entity").distinct()
    each = F.array(*[F.struct(F.lit(k).alias("model_key")) for k in params])
    return ents.select("entity", F.explode(each).alias("m")).select("entity", "m.model_key").join(F.broadcast(listed), "model_key").select("entity", "model_key", "params", F.lit(None).cast("double").alias("cv_score"))


def tree_models(stack: Stack, params: DataFrame, cfg: RunConfig, fit_role: str = "fit") -> DataFrame:
    """The trees (``forest.MODEL``) of every (entity, model_key) of ``params``, fitted on the rows of a role in one job."""
    rows = fit_rows(stack, fit_role, params.select("entity").distinct())
    models = forest.fit_models(forest.packed_rows(rows, stack.slots, "y_t"), params.select("entity", "model_key", "params"), cfg.seed)
    if (of_long := long_rows(rows)) is not None:
        models = models.unionByName(levels.fit_models(of_long, stack.slots, "y_t", params, cfg.seed))
    return cut_lineage(models)


def tree_predictions(stack: Stack, models: DataFrame, pred_role: str = "holdout") -> DataFrame:
    """Predictions of all tree models for the rows of a role."""
    return forest.predict_models(stack.frame.filter(F.col("role") == pred_role), models, stack.slots)


def to_predictions(pred: DataFrame) -> DataFrame:
    """(entity, model_key, period, actual, predicted) on the count scale (expm1, clip at 0)."""
    return pred.select("entity", "model_key", "period", F.col("target").cast("double").alias("actual"),
                       expm1_clip("predicted_t").alias("predicted"))


def tuned_or_default(stack: Stack, keys: list[str], cfg: RunConfig, tune, entities: dict[str, DataFrame] | None = None) -> DataFrame:
    """Parameters of tree models: searched for the models named in ``tune``, the defaults for others; ``entities`` limits a model to some entities."""
    parts = [tune_tree(stack, k, cfg, entities=(entities or {}).get(k)) if k in tune else given_params(stack, {k: {}}, (entities or {}).get(k)) for k in keys]
    return reduce(DataFrame.unionByName, parts)


def train_evaluate(stack: Stack, keys: list[str], cfg: RunConfig, tune=tuple(MD.TREE_MODELS)) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """#80: hold-out predictions for ``keys``, and the tree models' parameters and trees (None without tree models)."""
    preds, params, models = [], None, None
    lin = [k for k in keys if k in MD.LINEAR_MODELS]
    if lin:
        preds.append(linear_predictions(stack, lin))
    if trees := [k for k in keys if k in MD.TREE_MODELS]:
        params = cut_lineage(tuned_or_default(stack, trees, cfg, tune))
        models = tree_models(stack, params, cfg)
        preds.append(tree_predictions(stack, models))
    cols = ["entity", "model_key", "period", "target", "predicted_t"]
    return reduce(DataFrame.unionByName, [to_predictions(p.select(*cols)) for p in preds]), params, models


# --------------------------------------------------------------------------- #
# forecasting
# --------------------------------------------------------------------------- #
def best_coefficients(stack_full: Stack, best: DataFrame) -> DataFrame:
    """Coefficients, on all train rows, of the entities whose best model is linear: (entity, model_key, intercept, coef)."""
    coefs = MD.fit_linear_family(stack_full.frame.filter(F.col("role") == "fit"), "entity", stack_full.slots, "y_t")
    return coefs.join(broadcast_if_small(best.select("entity", "model_key")), ["entity", "model_key"], "left_semi")


def best_trees(stack_full: Stack, best: DataFrame, cfg: RunConfig, tune=tuple(MD.TREE_MODELS)) -> DataFrame | None:
    """Trees, on all train rows and searched anew there, of the entities whose best model is one; None if no entity's is."""
    keys = [r.model_key for r in best.select("model_key").distinct().collect() if r.model_key in MD.TREE_MODELS]  # at most eight
    if not keys:
        return None
    params = tuned_or_default(stack_full, sorted(keys), cfg, tune, {k: best.where(F.col("model_key") == k) for k in keys})
    return tree_models(stack_full, params, cfg)


def forecast_direct(stack_full: Stack, best: DataFrame, cfg: RunConfig, tune=tuple(MD.TREE_MODELS)) -> DataFrame:
    """#81: the best model of each entity (entity, model_key) refit on all train rows; predict test; clip; round (half-even).

    The trees named in ``tune`` are tuned anew on all train rows; others have the defaults.
    """
    test = stack_full.frame.filter(F.col("role") == "test")
    cols = ["entity", "year", "weekofyear", "period", "model_key", "predicted_t"]
    res = MD.predict_linear(test, best_coefficients(stack_full, best), "entity", stack_full.slots).select(*cols)
    models = best_trees(stack_full, best, cfg, tune)
    if models is not None:
        res = res.unionByName(tree_predictions(stack_full, models, "test").select(*cols))
    return res.select("entity", "year", "weekofyear", "period", "model_key",
                      rint_long(expm1_clip("predicted_t")).alias("total_cases"))


def _case_slot_weights(stack: Stack, coefs: DataFrame) -> DataFrame:
    """Per (entity, model): intercept and coefficients split into weather and case parts.

    Returns entity, model_key, c0 (intercept minus the case slots' centring),
    w_lag_1..4, w_roll_4 (coefficient / scale for each case feature; 0 when
    the feature was not selected), plus the weather-slot coefficient array.
    """
    case = stack.case_names
    st = stack.scaler
    j = coefs.join(st, "entity").join(
        stack.frame.select("entity", "sel_names").dropDuplicates(["entity"]), "entity")
    out = [F.col("entity"), F.col("model_key")]
    c0 = F.col("intercept")
    weights = {}
    for cname in case:
        wsum = F.lit(0.0)
        for jx, s in enumerate(stack.slots):
            hit = F.col("sel_names")[jx] == F.lit(cname)
            w = F.when(hit, F.col("coef")[jx] / F.col(f"{s}__scale")).otherwise(F.lit(0.0))
            wsum = wsum + w
            c0 = c0 - F.when(hit, F.col("coef")[jx] * F.col(f"{s}__mean") / F.col(f"{s}__scale")).otherwise(F.lit(0.0))
        weights[cname] = wsum
    wx = F.array(*[F.when(F.col("sel_names")[jx].isin(case), F.lit(0.0)).otherwise(F.col("coef")[jx])
                   for jx in range(stack.k)])
    return j.select(*out, c0.alias("c0"), *[v.alias(f"w__{n}") for n, v in weights.items()], wx.alias("wx"))


def forecast_recursive_linear(stack_full: Stack, coefs: DataFrame) -> DataFrame:
    """#82 for linear models: the recursion as one Catalyst array fold per entity.

    State = the last four known counts; each step forms the case features
    from the state, adds the weather part (pre-computed per test row), applies
    expm1 and the clip, and pushes the UNROUNDED prediction into the state.
    Only the test block of each entity (the forecast horizon) is folded.
    """
    fr = stack_full.frame
    w = _case_slot_weights(stack_full, coefs)
    lags = [n for n in stack_full.case_names if "_lag_" in n]
    test = fr.filter(F.col("role") == "test").join(w, "entity")
    weather = F.aggregate(F.zip_with(F.col("wx"), F.array(*[F.coalesce(F.col(s), F.lit(0.0)) for s in stack_full.slots]),
                                     lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    steps = test.select("entity", "model_key", "period", "year", "weekofyear", (F.col("c0") + weather).alias("base"),
                        *[F.col(f"w__{n}") for n in stack_full.case_names])
    hist_w = Window.partitionBy("entity").orderBy(F.col("period").desc())
    known = (fr.filter(F.col("split") == "train").select("entity", "period", F.col("target").cast("double").alias("v"),
                                                        F.row_number().over(hist_w).alias("back"))
             .filter(F.col("back") <= 4).groupBy("entity")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("back") * -1, "v"))).alias("h"))
             .select("entity", F.transform("h", lambda s: s["v"]).alias("hist")))
    seq = (steps.groupBy("entity", "model_key")
                .agg(F.array_sort(F.collect_list(F.struct("period", "year", "weekofyear", "base",
                     *[F.col(f"w__{n}").alias(n) for n in stack_full.case_names]))).alias("xs"))
                .join(known, "entity"))

    def merge(state, x):
        h = state["hist"]
        n = F.size(h)
        lin = x["base"]
        for name in lags:
            k = int(name.rsplit("_", 1)[1])
            lin = lin + x[name] * F.when(n >= k, F.element_at(h, n - k + 1))
        if "cases_rollmean_4" in stack_full.case_names:
            last4 = F.slice(h, F.greatest(n - 3, F.lit(1)), 4)
            mean4 = F.aggregate(last4, F.lit(0.0), lambda a, b: a + b) / F.size(last4)
            lin = lin + x["cases_rollmean_4"] * mean4
        v = F.greatest(F.expm1(lin), F.lit(0.0))
        return F.struct(F.slice(F.concat(h, F.array(v)), F.greatest(F.size(h) + 2 - 4, F.lit(1)), 4).alias("hist"),
                        F.concat(state["preds"], F.array(v)).alias("preds"))

    init = F.struct(F.col("hist").alias("hist"), F.array().cast("array<double>").alias("preds"))
    folded = seq.select("entity", "model_key", "xs", F.aggregate("xs", init, merge)["preds"].alias("preds"))
    ex = folded.select("entity", "model_key", F.posexplode("xs").alias("i", "x"), "preds")
    return ex.select("entity", "model_key", F.col("x.period").alias("period"), F.col("x.year").alias("year"),
                     F.col("x.weekofyear").alias("weekofyear"), F.col("preds")[F.col("i")].alias("predicted"))


def case_parts(names: list[str]) -> dict[str, tuple[str, int]]:
    """What each configured case feature reads from the past counts: ("lag", k) or ("rollmean", window)."""
    found = {n: re.fullmatch(r"cases_(lag|rollmean)_(\d+)", n) for n in names}
    if unknown := [n for n, m in found.items() if m is None]:
        raise ValueError(f"case features without a recursion: {unknown}")
    return {n: (m[1], int(m[2])) for n, m in found.items()}


def case_value(past: np.ndarray, kind: str, size: int) -> float:
    """A case feature of the next period; nan while too little is known (a mean needs two counts)."""
    if kind == "lag":
        return past[-size] if len(past) >= size else np.nan
    return past[-size:].mean() if min(size, len(past)) >= 2 else np.nan


REC_SCHEMA = "entity string, model_key string, period date, year int, weekofyear int, predicted double"


def forecast_recursive_tree(stack_full: Stack, models: DataFrame) -> DataFrame:
    """#82 for tree models: each entity's recursion runs inside one task.

    The test block of an entity (its forecast horizon) meets the trees of its
    models by entity; the last known counts - as many as the configured case
    features look back - and the case slots' scaling ride along. The horizon is
    one fold whose state is those counts: each period's unrounded forecast
    joins the state of the next.
    """
    case = list(stack_full.case_names)
    depth = max([2, *(size for _, size in case_parts(case).values())])
    slots = stack_full.slots
    fr = stack_full.frame
    hist_w = Window.partitionBy("entity").orderBy(F.col("period").desc())
    known = (fr.filter(F.col("split") == "train")
               .select("entity", "period", F.col("target").cast("double").alias("v"),
                       F.row_number().over(hist_w).alias("back"))
               .filter(F.col("back") <= depth).groupBy("entity")
               .agg(F.array_sort(F.collect_list(F.struct((F.col("back") * -1).alias("o"), "v"))).alias("h"))
               .select("entity", F.transform("h", lambda s: s["v"]).alias("hist")))
    st = stack_full.scaler.select("entity", F.array(*[F.col(f"{s}__mean") for s in slots]).alias("mu"),
                                  F.array(*[F.col(f"{s}__scale") for s in slots]).alias("sd"))
    test = (fr.filter(F.col("role") == "test")
              .select("entity", F.col("period").cast("date").alias("period"), F.col("year").cast("int").alias("year"), F.col("weekofyear").cast("int").alias("weekofyear"), "sel_names",
                      F.array(*[F.coalesce(F.col(s), F.lit(0.0)) for s in slots]).alias("x"))
              .join(known, "entity").join(broadcast_if_small(st), "entity"))
    parts, Ensemble, value_of = case_parts(case), forest.Ensemble, case_value

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and trees.num_rows:
            rows = rows.sort_by("period")
            chosen = rows.column("sel_names")[0].as_py()
            at = [j for j, name in enumerate(chosen) if name in parts]
            centre, width = (np.asarray(rows.column(c)[0].as_py(), float)[at] for c in ("mu", "sd"))
            inputs = np.array(rows.column("x").to_pylist(), float)
            for key in sorted(trees.column("model_key").unique().to_pylist()):
                model = Ensemble(trees.filter(pa.compute.equal(trees.column("model_key"), key)).sort_by("tree"))

                def step(state, x):
                    past = state[0]
                    x = x.copy()
                    x[at] = (np.array([value_of(past, *parts[chosen[j]]) for j in at]) - centre) / width
                    count = float(np.maximum(np.expm1(model.forecast(x[None, :])[0]), 0.0))
                    return np.append(past, count)[-depth:], count

                states = itertools.accumulate(inputs, step, initial=(np.asarray(rows.column("hist")[0].as_py(), float), None))
                forecast = [count for _, count in states][1:]
                out.append(rows.select(["entity"]).append_column("model_key", pa.array([key] * len(forecast))).append_column("period", rows.column("period")).append_column("year", rows.column("year")).append_column("weekofyear", rows.column("weekofyear")).append_column("predicted", pa.array(forecast)))
        empty = pa.table({"entity": pa.array([], pa.string()), "model_key": pa.array([], pa.string()), "period": pa.array([], pa.date32()), "year": pa.array([], pa.int32()), "weekofyear": pa.array([], pa.int32()), "predicted": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out])

    return test.groupBy("entity").cogroup(models.drop("gain").groupBy("entity")).applyInArrow(run, REC_SCHEMA)
