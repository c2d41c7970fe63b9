"""End-to-end forecast runs (#83 weather only, #84 autoregressive, #85 signal
ablation) and their report sinks (#2-#7, #54, #67).

A run is a handful of Spark jobs over one entity-partitioned panel; parameters,
models and the best model of each entity stay DataFrames.  The cleaned panel and the stacks (selection + scaling),
checkpointed, are memoised per session so several report queries share one scan and one build.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import forest
from ..operators import metrics as M
from ..operators import models as MD
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.panels import standard_panel
from ..spec import PanelSpec
from . import flagship as FL
from . import modelling as ML

# The registered queries search the reference's full spaces: every grid point
# of the tree, 40 random candidates of each ensemble, four folds.
QUERY_CFG = ML.RunConfig()

_STACKS: dict = {}
_PANELS: dict = {}


def panel_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned weekly panel, written to the checkpoint folder once a session: all stacks come from one scan of the orders."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PANELS:
        _PANELS[key] = cut_lineage(FL.cleaned_panel(spark, sf_dir))
    return _PANELS[key]


def stack_for(spark: SparkSession, sf_dir: str, autoregressive: bool = False, full_train: bool = False,
              cfg: ML.RunConfig | None = None) -> ML.Stack:
    cfg = cfg or QUERY_CFG
    key = (spark.sparkContext.applicationId, sf_dir, autoregressive, full_train, repr(cfg))
    if key not in _STACKS:
        eng, names, case = FL.engineer(panel_for(spark, sf_dir).repartition("entity"), FL.SPEC, autoregressive=autoregressive)
        _STACKS[key] = ML.build_stack(eng, names, case, cfg, full_train=full_train)
    return _STACKS[key]


def output_root(spark: SparkSession) -> str:
    """Sink folder: ``spark.weftcast.outputDir`` if set, else under the shared checkpoint folder."""
    base = spark.conf.get("spark.weftcast.outputDir", None) or os.path.join(ensure_checkpoint_dir(spark), "outputs")
    return os.path.join(base, uuid.uuid4().hex[:12])


# --------------------------------------------------------------------------- #
# importances
# --------------------------------------------------------------------------- #
def importances(stack: ML.Stack, models: DataFrame) -> DataFrame:
    """#76: (entity, model_key, feature, slot, importance) of fitted tree models, for every selected feature of the entity."""
    names = stack.frame.select("entity", "sel_names").dropDuplicates(["entity"])
    slots = names.select("entity", F.posexplode("sel_names").alias("slot", "feature"))
    fitted = models.select("entity", "model_key").distinct()
    found = forest.importances(models)
    return slots.join(fitted, "entity").join(found, ["entity", "model_key", "slot"], "left").select(
        "entity", "model_key", "feature", "slot", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def top_importances(imp: DataFrame, n: int = 20) -> DataFrame:
    """#54: top-n importances per (entity, tree model); linear models have none."""
    w = Window.partitionBy("entity", "model_key").orderBy(F.col("importance").desc(), F.col("slot"))
    return imp.select("*", F.row_number().over(w).alias("imp_rank")).filter(F.col("imp_rank") <= n)


# --------------------------------------------------------------------------- #
# runs
# --------------------------------------------------------------------------- #
@dataclass
class RunResult:
    predictions: DataFrame
    metrics: DataFrame
    ranked: DataFrame
    combined: DataFrame
    best: DataFrame
    submission: DataFrame
    importances: DataFrame | None
    params: DataFrame | None = None  # entity, model_key, params (JSON), cv_score
    models: DataFrame | None = None  # stored_models


def evaluate(stack: ML.Stack, keys: list[str], cfg: ML.RunConfig, tune=tuple(MD.TREE_MODELS)):
    """Hold-out predictions for ``keys`` plus parameters, trees and importances of the tree models."""
    preds, params, models = ML.train_evaluate(stack, keys, cfg, tune)
    return cut_lineage(preds), params, models, None if models is None else importances(stack, models)


def run_forecast(spark: SparkSession, sf_dir: str, autoregressive: bool = False,
                 keys: list[str] | None = None, cfg: ML.RunConfig | None = None, tune=tuple(MD.TREE_MODELS),
                 output_dir: str | None = None) -> RunResult:
    """#83 / #84: evaluate every model, rank, pick the best per entity, forecast the test rows.

    The tree models named in ``tune`` are searched for, the others have their defaults. With ``output_dir`` all reports, predictions, the submission and all fitted models are written there.
    """
    cfg = cfg or QUERY_CFG
    return run_stacks(stack_for(spark, sf_dir, autoregressive, False, cfg),
                      lambda: stack_for(spark, sf_dir, autoregressive, True, cfg), autoregressive, keys, cfg, tune, output_dir)


def run_panel(panel: DataFrame, spec: PanelSpec = FL.SPEC, autoregressive: bool = False, keys: list[str] | None = None,
              cfg: ML.RunConfig | None = None, tune=tuple(MD.TREE_MODELS), output_dir: str | None = None,
              redundant: tuple = ()) -> RunResult:
    """#83 / #84 on a panel of one's own (``sources.panels.read_panel``), whatever its columns are called.

    Nothing is memoised: the engineered panel is written to the checkpoint folder and both stacks come from it.
    """
    cfg = cfg or QUERY_CFG
    eng, names, case = FL.engineered(standard_panel(panel, spec, redundant), autoregressive)
    eng = cut_lineage(eng)
    return run_stacks(ML.build_stack(eng, names, case, cfg, full_train=False),
                      lambda: ML.build_stack(eng, names, case, cfg, full_train=True), autoregressive, keys, cfg, tune, output_dir)


def run_stacks(stack: ML.Stack, full_stack: Callable[[], ML.Stack], autoregressive: bool, keys: list[str] | None,
               cfg: ML.RunConfig, tune: tuple, output_dir: str | None) -> RunResult:
    """A run on the stack of the hold-out split and that of all train rows, which is built once the first is evaluated."""
    keys = keys or MD.ALL_MODELS
    preds, params, models, imp = evaluate(stack, keys, cfg, tune)
    scored = M.forecast_metrics(preds)
    metrics = M.metrics_table(scored, tuple(tune), extra=("n",))
    ranked = M.rank_models(metrics, "mae")
    combined = M.combined_scores(preds)
    best = cut_lineage(M.best_model_per_entity(metrics))
    submission = (recursive_submission if autoregressive else ML.forecast_direct)(full_stack(), best, cfg, tune)
    lin = [k for k in keys if k in MD.LINEAR_MODELS]
    coefs = MD.fit_linear_family(stack.frame.filter(F.col("role") == "fit"), "entity", stack.slots, "y_t", lin) if lin else None
    res = RunResult(preds, metrics, ranked, combined, best, submission, imp, params, stored_models(coefs, models))
    if output_dir:
        write_reports(res, output_dir)
    return res


def recursive_submission(full: ML.Stack, best: DataFrame, cfg: ML.RunConfig, tune=tuple(MD.TREE_MODELS)) -> DataFrame:
    """#82: recursive test forecast with each entity's best model, refit - trees also tuned anew - on all train rows."""
    cols = ["entity", "year", "weekofyear", "period", "model_key", "predicted"]
    out = ML.forecast_recursive_linear(full, ML.best_coefficients(full, best)).select(*cols)
    models = ML.best_trees(full, best, cfg, tune)
    if models is not None:
        out = out.unionByName(ML.forecast_recursive_tree(full, models).select(*cols))
    return out.select("entity", "year", "weekofyear", "period", "model_key",
                      F.rint(F.col("predicted")).cast("long").alias("total_cases"))


# --------------------------------------------------------------------------- #
# model store
# --------------------------------------------------------------------------- #
TREE_COLUMNS = ["tree", "weight", "feature", "threshold", "left", "right", "value", "gain"]


def stored_models(coefs: DataFrame | None, trees: DataFrame | None) -> DataFrame:
    """#7: one table of all fitted models: a row of coefficients for a linear one, a row of nodes for each tree."""
    parts = [p for p in (None if coefs is None else coefs.select("entity", "model_key", "intercept", "coef"),
                         None if trees is None else trees.select("entity", "model_key", *TREE_COLUMNS)) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_models(models: DataFrame, path: str) -> str:
    """Write ``stored_models``, a folder for each model_key."""
    models.write.mode("overwrite").partitionBy("model_key").parquet(path)
    return path


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Coefficients and trees of a written model store."""
    stored = spark.read.parquet(path)
    return (stored.where(F.col("model_key").isin(MD.LINEAR_MODELS)).select("entity", "model_key", "intercept", "coef"),
            stored.where(F.col("model_key").isin(MD.TREE_MODELS)).select("entity", "model_key", *TREE_COLUMNS))


def score_models(rows: DataFrame, coefs: DataFrame, trees: DataFrame, slots: list[str]) -> DataFrame:
    """``rows`` with (model_key, predicted_t) of every stored model of their entity."""
    lin = MD.predict_linear(rows, coefs, "entity", slots)
    tree = forest.predict_models(rows, trees, slots)
    return lin.select(*tree.columns).unionByName(tree)


def signal_ablation(spark: SparkSession, sf_dir: str, keys=("random_forest", "xgboost"),
                    cfg: ML.RunConfig | None = None) -> DataFrame:
    """#85: the same tuned models on climate-only and climate + cases features, per entity."""
    cfg = cfg or QUERY_CFG
    out = None
    for signal, ar in (("climate_only", False), ("climate_cases", True)):
        stack = stack_for(spark, sf_dir, ar, False, cfg)
        preds = evaluate(stack, list(keys), cfg)[0]
        s = preds.withColumn("signal", F.lit(signal))
        out = s if out is None else out.unionByName(s)
    return M.signal_comparison(out)


# --------------------------------------------------------------------------- #
# sinks and reports
# --------------------------------------------------------------------------- #
def write_predictions(preds: DataFrame, root: str) -> str:
    """#4: hold-out predictions, one folder per (entity, model_key), CSV with header."""
    path = os.path.join(root, "predictions")
    (preds.select("entity", "model_key", F.col("period").alias("week_start_date"), "actual", "predicted")
          .repartition("entity", "model_key")
          .write.mode("overwrite").partitionBy("entity", "model_key").option("header", True).csv(path))
    return path


PRED_FILE_SCHEMA = "week_start_date date, actual double, predicted double, entity string, model_key string"


def scan_holdout_predictions(spark: SparkSession, path: str) -> DataFrame:
    """#2: read the per-(entity, model) files back; identity comes from the partition folders, which filters prune."""
    df = spark.read.schema(PRED_FILE_SCHEMA).option("header", True).csv(path)
    return df.select("entity", "model_key", "week_start_date", "actual", "predicted")


def write_reports(res: RunResult, root: str) -> dict:
    """#3 / #5 / #6: metrics, ranked, combined and best tables as CSV; summary JSON; text report."""
    paths = {}
    for name, df in (("all_metrics", res.metrics), ("ranked_metrics", res.ranked),
                     ("combined_scores", res.combined), ("best_models", res.best)):
        p = os.path.join(root, "reports", name)
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(p)
        paths[name] = p
    paths["predictions"] = write_predictions(res.predictions, root)
    summary_path = os.path.join(root, "reports", "run_summary")
    run_summary(res).coalesce(1).write.mode("overwrite").json(summary_path)
    paths["run_summary"] = summary_path
    paths["submission"] = os.path.join(root, "submission")
    res.submission.repartition("entity").write.mode("overwrite").partitionBy("entity").option("header", True).csv(paths["submission"])
    if res.models is not None:
        paths["models"] = write_models(res.models, os.path.join(root, "models"))
    rep = os.path.join(root, "reports", "model_comparison_report")
    comparison_report(res.ranked, res.combined).orderBy("section_order", "line_no").select("line") \
        .coalesce(1).write.mode("overwrite").text(rep)
    paths["report"] = rep
    return paths


def run_summary(res: RunResult) -> DataFrame:
    """#5: best model per entity, pooled best, number of models, entity list - one row."""
    # two one-row aggregates (per-entity bests, pooled ranking) keyed by the same constant
    best = res.best.groupBy(F.lit(1).alias("k")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "model")))).alias("best_by_entity"),
        F.array_sort(F.collect_list("entity")).alias("entities"))
    comb = res.combined.groupBy(F.lit(1).alias("k")).agg(F.min_by("model", "rank").alias("combined_best"),
                                                         F.count(F.lit(1)).alias("n_models"))
    return best.join(comb, "k").select("best_by_entity", "combined_best", "n_models", "entities",
                                       F.to_json(F.struct("best_by_entity", "combined_best", "n_models",
                                                          "entities")).alias("json"))


# The report's columns (title, printf width, printf type) and its sentences.
REPORT_COLUMNS = [("Rank", "-5", "d"), ("Model", "-24", "s"), ("MAE", "10", ".3f"), ("RMSE", "10", ".3f"), ("R2", "10", ".3f"), ("Tuned", "8", "s")]
BEST_LINE = "  -> Best for %s: %s (MAE=%.3f)"
OVERALL_LINE = "Overall best (combined MAE): %s (MAE=%.3f)"


def report_header(columns: list[tuple[str, str, str]]) -> str:
    return "".join(f"%{width}s" % title for title, width, _ in columns)


def report_row(columns: list[tuple[str, str, str]]) -> str:
    """The printf format of a row."""
    return "".join(f"%{width}{kind}" for _, width, kind in columns)


def comparison_report(ranked: DataFrame, combined: DataFrame) -> DataFrame:
    """#6: the fixed-width comparison report as (section, section_order, line_no, line)."""
    row_fmt, header = report_row(REPORT_COLUMNS), report_header(REPORT_COLUMNS)
    ents = ranked.select("entity").distinct()
    e_order = Window.orderBy("entity")
    ents = ents.select("entity", F.row_number().over(e_order).alias("section_order"))
    per = ranked.join(ents, "entity")
    rows = per.select("entity", "section_order", (F.col("rank") + 3).alias("line_no"),
                      F.format_string(row_fmt, F.col("rank"), F.col("model"), F.col("mae"), F.col("rmse"),
                                      F.col("r2"), F.initcap(F.col("tuned").cast("string"))).alias("line"))
    title = ents.select("entity", "section_order", F.lit(0).alias("line_no"),
                        F.concat(F.lit("--- Entity: "), F.upper("entity"), F.lit(" "),
                                 F.expr("repeat('-', greatest(66 - length(entity), 0))")).alias("line"))
    hdr = ents.select("entity", "section_order", F.lit(1).alias("line_no"), F.lit(header).alias("line"))
    rule = ents.select("entity", "section_order", F.lit(2).alias("line_no"), F.lit("-" * len(header)).alias("line"))
    best = per.filter(F.col("rank") == 1).select(
        "entity", "section_order", F.lit(1000).alias("line_no"),
        F.format_string(BEST_LINE, F.upper("entity"), F.col("model"), F.col("mae")).alias("line"))
    body = rows.unionByName(title).unionByName(hdr).unionByName(rule).unionByName(best)
    pooled = REPORT_COLUMNS[:-1]
    chdr = report_header(pooled)
    comb_rows = combined.select(F.lit("combined").alias("entity"), F.lit(10 ** 6).alias("section_order"),
                                (F.col("rank") + 3).alias("line_no"),
                                F.format_string(report_row(pooled), "rank", "model", "mae", "rmse", "r2")
                                .alias("line"))
    spark = ranked.sparkSession
    fixed = spark.createDataFrame(
        [("combined", 10 ** 6, 0, "--- Combined (all entities pooled) " + "-" * 39),
         ("combined", 10 ** 6, 1, chdr), ("combined", 10 ** 6, 2, "-" * len(chdr))],
        "entity string, section_order int, line_no int, line string")
    overall = combined.filter(F.col("rank") == 1).select(
        F.lit("combined").alias("entity"), F.lit(10 ** 6).alias("section_order"), F.lit(1000).alias("line_no"),
        F.format_string(OVERALL_LINE, "model", "mae").alias("line"))
    return body.unionByName(comb_rows).unionByName(fixed).unionByName(overall) \
               .withColumnRenamed("entity", "section")


def model_dashboard(res: RunResult) -> DataFrame:
    """#67: one row per (entity, model): metrics, tuned flag, <= 8 params, series, residuals, top-12 importances."""
    p = res.predictions
    series = p.groupBy("entity", "model_key").agg(
        F.array_sort(F.collect_list(F.struct("period", "actual", "predicted"))).alias("series"))
    series = series.select("*", F.transform("series", lambda s: s["actual"] - s["predicted"]).alias("residuals"))
    out = res.metrics.join(series, ["entity", "model_key"])
    if res.params is not None:
        out = out.join(res.params.select("entity", "model_key", F.col("params").alias("best_params")), ["entity", "model_key"], "left")
    else:
        out = out.withColumn("best_params", F.lit(None).cast("string"))
    if res.importances is not None:
        top = top_importances(res.importances, 12).groupBy("entity", "model_key").agg(
            F.array_sort(F.collect_list(F.struct("imp_rank", "feature", "importance"))).alias("top_importances"))
        out = out.join(top, ["entity", "model_key"], "left")
    return out
