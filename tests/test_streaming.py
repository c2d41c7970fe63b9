"""The streamed weekly panel equals the batch panel."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from weftcast.sources import panels as P
from weftcast.streaming import ingest_weekly_panel


def test_stream_ingest_equals_batch(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="weftcast-stream-"), "weekly")
    ingest_weekly_panel(spark, SF_SMALL, out)
    got = spark.read.parquet(out).select("entity", "period", "target", F.round("f_price", 6).alias("p"))
    exp = P.weekly_aggregate(spark, SF_SMALL).select("entity", "period", "target", F.round("f_price", 6).alias("p"))
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0
