"""Report tables from a run result built on the ML-free predictions (fast)."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weftcast.operators import metrics as M
from weftcast.plans import flagship as FL
from weftcast.plans import runs as RN


def _result(spark):
    preds = FL.naive_predictions(spark, SF_SMALL)
    metrics = M.metrics_table(M.forecast_metrics(preds))
    return RN.RunResult(preds, metrics, M.rank_models(metrics, "mae"), M.combined_scores(preds),
                        M.best_model_per_entity(metrics), preds.limit(0), None)


def test_run_summary_one_row(spark):
    res = _result(spark)
    rows = RN.run_summary(res).collect()
    assert len(rows) == 1
    js = json.loads(rows[0]["json"])
    assert js["n_models"] == 3 and len(js["best_by_entity"]) == len(js["entities"]) == 5
    assert js["combined_best"] == res.combined.filter(F.col("rank") == 1).first()["model"]


def test_comparison_report_layout(spark):
    res = _result(spark)
    lines = [r["line"] for r in RN.comparison_report(res.ranked, res.combined)
             .orderBy("section_order", "line_no").collect()]
    assert lines[0].startswith("--- Entity: ") and lines[1].startswith("Rank Model")
    assert any(ln.startswith("  -> Best for ") for ln in lines)
    assert lines[-1].startswith("Overall best (combined MAE): ")
    row = lines[3]
    assert len(row) == 5 + 24 + 10 * 3 + 8


def test_model_dashboard_rows(spark):
    res = _result(spark)
    d = RN.model_dashboard(res)
    assert d.count() == res.metrics.count()
    r = d.first()
    assert len(r["series"]) == len(r["residuals"]) > 0
