"""Tests of the findings F1 to F4 of FINDINGS_r03.md: what a run reads and sends to the driver."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.plans import flagship as FL
from weftcast.plans import modelling as ML
from weftcast.plans import runs as RN
from weftcast.sources import panels


@pytest.fixture
def weekly_tables(spark, tmp_path):
    """Orders of two segments over 120 weeks, the last of them test weeks."""
    rng = np.random.default_rng(5)
    customers = [(k, ("A", "B")[k % 2], float(rng.normal(100, 30))) for k in range(40)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(int(rng.integers(0, 40)), dt.datetime(1998, 6, 1) + dt.timedelta(days=int(d)), float(rng.uniform(1, 100)), ("1-URGENT", "5-LOW")[int(rng.integers(2))], ("P", "F")[int(rng.integers(2))])
              for d in rng.integers(0, 840, 8000)]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_large_customer_is_not_broadcast(spark, weekly_tables, tmp_path):
    columns = ["entity", "period", "target", "split"]
    known = sorted(map(str, panels.weekly_panel(spark, weekly_tables).select(columns).collect()))
    more = spark.range(1000, 150000).select(F.col("id").alias("c_custkey"), F.lit("A").alias("c_mktsegment"), F.rand(1).alias("c_acctbal"))
    large = tmp_path / "large"
    spark.read.parquet(f"{weekly_tables}/customer.parquet").unionByName(more).write.parquet(str(large / "customer.parquet"))
    spark.read.parquet(f"{weekly_tables}/orders.parquet").write.parquet(str(large / "orders.parquet"))
    table = panels.weekly_panel(spark, str(large))
    assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, table.select(columns).collect())) == known


def test_all_stacks_of_a_session_come_from_one_scan(spark, weekly_tables, monkeypatch):
    scans, built = [], []
    scan = FL.weekly_panel
    monkeypatch.setattr(FL, "weekly_panel", lambda *a: scans.append(a) or scan(*a))
    monkeypatch.setattr(ML, "build_stack", lambda eng, *a, **kw: built.append(eng) or object())
    for autoregressive in (False, True):
        for full in (False, True):
            RN.stack_for(spark, weekly_tables, autoregressive, full)
    assert len(scans) == 1 and len(built) == 4
    assert not any("orders.parquet" in "".join(eng.inputFiles()) for eng in built)
    whole = FL.engineered_panel(spark, weekly_tables, True)[0]
    assert built[2].count() == whole.count() and built[2].columns == whole.columns
