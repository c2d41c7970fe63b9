"""Panels derived from the driver tables (#1 scan_panel, #10 prepare_dates).

``weekly_panel``: market segment x ISO week aggregated from orders joined to
customers.  The segment plays the reference's city; the weekly order count is
the target; the predictors are weekly averages, one of them a deliberate
duplicate (the reference drops one known-redundant column).

Scale notes
-----------
* orders is the fact table: only 6 of its columns are read (ReadSchema).
* customer grows with orders, so it goes through the driver, as a broadcast, only
  up to ``CUSTOMER_BROADCAST`` of its files; beyond that the join is a sort-merge
  join with AQE skew splitting (one customer may own a third of all orders).
* What the join moves of an order is its week, price, urgent price and whether
  it is finished, no texts.
* One aggregation feeds both the feature rows and the label rows; the two
  projections share the same exchange (ReuseExchange), so orders is scanned once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite_or_null
from ..operators.joins import join_labels
from ..session import plan_size_bytes
from ..spec import PanelSpec, feature_columns, numeric_columns
from .tables import read_table

PANEL_SPEC = PanelSpec(entity="entity", period="period", target="target",
                       split="split", extra_keys=("year", "weekofyear"))

# Fixed panel parameters (chosen once; the oracle SQL uses the same values).
WEEKLY_TEST_FROM = dt.date(2000, 7, 1)
DAILY_TEST_FROM = dt.date(2024, 1, 24)
CUSTOMER_BROADCAST = 1 << 20  # bytes of customer, as the optimizer puts them; a broadcast is several times as large
REDUNDANT_COLUMNS = ["f_price_dup"]
WEEKLY_FEATURES = ["f_price", "f_urgent", "f_acct", "f_price_dup"]
DAILY_FEATURES = ["f_avg", "f_max", "f_std", "f_users"]


def _split_tag(period_col: str, test_from: dt.date):
    return F.when(F.col(period_col) < F.lit(test_from), F.lit("train")).otherwise(F.lit("test"))


def weekly_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, period, year, weekofyear, f_*, target, split) from orders x customer.

    Join, then one map-side-combined aggregation: the only exchange of fact
    rows is that of the join, and there is none where customer is small enough
    to broadcast; beyond that a sort-merge join with AQE skew splitting.  What
    is shuffled by (segment, week) is one row per group and map task.
    """
    orders = read_table(spark, sf_dir, "orders",
                        ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"])
    period = F.to_date(F.date_trunc("week", F.col("o_orderdate")))
    urgent_p = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    price = F.col("o_totalprice")
    orders = orders.select("o_custkey", period.alias("period"), price.alias("price"), F.when(urgent_p, price).alias("urgent"),
                           (F.col("o_orderstatus") == "F").alias("finished"))
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    size = plan_size_bytes(customer)
    customer = F.broadcast(customer) if size is not None and size <= CUSTOMER_BROADCAST else customer.hint("merge")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
    agg = (joined.groupBy(F.col("c_mktsegment").alias("entity"), "period")
           .agg(F.avg("price").alias("f_price"),
                F.avg("urgent").alias("f_urgent"),
                F.avg(F.when(F.col("finished"), F.col("c_acctbal"))).alias("f_acct"),
                F.avg("price").alias("f_price_dup"),
                F.count(F.lit(1)).alias("target")))
    return agg.select(
        "entity", "period",
        F.expr("extract(YEAROFWEEK FROM period)").cast("int").alias("year"),
        F.weekofyear("period").alias("weekofyear"),
        *[finite_or_null(c).alias(c) for c in WEEKLY_FEATURES],
        "target",
        _split_tag("period", WEEKLY_TEST_FROM).alias("split"))


def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train + test feature rows (the reference's two feature files)."""
    return weekly_aggregate(spark, sf_dir).drop("target")


def panel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows (entity, year, weekofyear, target) for the train periods only."""
    agg = weekly_aggregate(spark, sf_dir)
    return agg.filter(F.col("split") == "train").select("entity", "year", "weekofyear", "target")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw panel: feature rows of both splits with the label on train rows (test target NULL).

    Features and labels come from the same aggregation here, so the label is
    attached by masking rather than by re-joining two copies of the aggregate
    (which would scan and aggregate orders twice).  ``operators.joins.join_labels``
    is the validated join for separately sourced labels (``join_labels`` query).
    """
    agg = weekly_aggregate(spark, sf_dir)
    target = F.when(F.col("split") == "train", F.col("target")).alias("target")
    return agg.select(*[target if c == "target" else F.col(c) for c in agg.columns])


def scan_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#1: feature rows of both splits with their labels attached (NULL on test)."""
    return weekly_panel(spark, sf_dir)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type x day panel from ``events`` (5 x 30 rows at every scale)."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value", "user_id"])
    day = F.to_date(F.date_trunc("day", F.col("ts")))
    agg = (ev.groupBy(F.col("event_type").alias("entity"), day.alias("period"))
             .agg(F.avg("value").alias("f_avg"),
                  F.max("value").alias("f_max"),
                  F.stddev_samp("value").alias("f_std"),
                  F.count_distinct("user_id").cast("double").alias("f_users"),
                  F.count(F.lit(1)).alias("target")))
    return agg.select(
        "entity", "period",
        F.expr("extract(YEAROFWEEK FROM period)").cast("int").alias("year"),
        F.weekofyear("period").alias("weekofyear"),
        *[finite_or_null(c).alias(c) for c in DAILY_FEATURES],
        F.when(F.col("period") < F.lit(DAILY_TEST_FROM), F.col("target")).alias("target"),
        _split_tag("period", DAILY_TEST_FROM).alias("split"))


# --------------------------------------------------------------------------- #
# panels of one's own
# --------------------------------------------------------------------------- #
def read_panel(features: DataFrame, labels: DataFrame, test: DataFrame, spec: PanelSpec = PANEL_SPEC) -> DataFrame:
    """One panel of feature rows, their labels and test rows, each from a source of its own.

    Labels join on the entity and ``spec.extra_keys`` (the period, if there are
    none); a key that repeats on either side fails the query, a feature row
    without a label keeps a NULL target.  Test rows have none; a predictor that
    they lack is NULL there.  A ``spec.target`` or ``spec.split`` column of the feature or
    test rows is not read.
    """
    keys = [spec.entity, *(spec.extra_keys or (spec.period,))]
    period = F.to_date(spec.period).alias(spec.period)

    def rows(df: DataFrame) -> DataFrame:
        skip = {spec.target, spec.split}
        return df.select(*[period if c == spec.period else F.col(c) for c in df.columns if c not in skip])

    known = labels.select(*[period if k == spec.period else F.col(k) for k in keys], spec.target)
    train = join_labels(rows(features), known, keys, validate="plan")
    train = train.select("*", F.lit("train").alias(spec.split))
    return train.unionByName(rows(test).select("*", F.lit("test").alias(spec.split)), allowMissingColumns=True)


def standard_panel(panel: DataFrame, spec: PanelSpec, redundant: tuple = ()) -> DataFrame:
    """``panel`` with the column names of ``PANEL_SPEC``, its numeric predictors only, and those named ``redundant`` dropped.

    Year and week of year come from the first two extra keys, or else from the
    period (ISO week).
    """
    keep = [c for c in numeric_columns(panel, feature_columns(panel, spec)) if c not in redundant]
    period = F.to_date(spec.period)
    year, week = ([F.col(k) for k in spec.extra_keys[:2]] if len(spec.extra_keys) >= 2
                  else [F.expr(f"extract(YEAROFWEEK FROM to_date(`{spec.period}`))"), F.weekofyear(period)])
    return panel.select(F.col(spec.entity).cast("string").alias("entity"), period.alias("period"),
                        year.cast("int").alias("year"), week.cast("int").alias("weekofyear"),
                        *[finite_or_null(F.col(c).cast("double")).alias(c) for c in keep],
                        F.col(spec.target).alias("target"), F.col(spec.split).alias("split"))
