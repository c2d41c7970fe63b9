
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from weftcast.plans import modelling as ML
from weftcast.plans import runs as RN


@pytest.fixture
def six_segments(spark, tmp_path):
    """The smallest tables with a sixth segment."""
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    sixth = F.when(F.col("c_custkey") % 4 == 0, "SIXTH").otherwise(F.col("c_mktsegment"))
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").withColumn("c_mktsegment", sixth).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_pivots_have_every_segment_of_the_data(spark, six_segments):
    table = E.queries()["model_comparison_pivot"](spark, six_segments)
    assert "SIXTH" in table.columns and table.where("metric = 'mae' and SIXTH is not null").count() == table.where("metric = 'mae'").count()
    table = E.queries()["missing_summary"](spark, six_segments)
    assert {"SIXTH_train", "SIXTH_test"} < set(table.columns) and table.where("max_pct < SIXTH_train").count() == 0


def test_registered_searches_are_the_references():
    found = {key: ML.candidates_for(key, RN.QUERY_CFG) for key in ("decision_tree", "random_forest", "xgboost", "lightgbm")}
    assert {k: (kind, len(c)) for k, (kind, c) in found.items()} == {"decision_tree": ("grid", 72), "random_forest": ("random", 40), "xgboost": ("random", 40), "lightgbm": ("random", 40)}
    assert RN.QUERY_CFG.n_splits == 4 and min(c["n_estimators"] for k in ("random_forest", "xgboost", "lightgbm") for c in found[k][1]) == 200
    assert {c["max_depth"] for c in found["decision_tree"][1]} == {3, 5, 7, 10, 15, None}
