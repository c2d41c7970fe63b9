"""Classifiers: held-out accuracy, folds, and odd rows; the solvers against plain formulas."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from weftcast.llm import features, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def confusion(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", F.col(column).alias("y")).collect()
    hit = sum(r.predicted and r.y for r in rows)
    return hit / max(1, sum(r.y for r in rows)), sum(r.predicted and not r.y for r in rows) / max(1, sum(not r.y for r in rows)), len(rows)


def check_rows(scored, docs, threshold):
    rows = scored.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_quality_on_the_held_out_fold(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op8_quality(spark, SF).cache()
    check_rows(scored, docs, 0.5)
    kept, wrong, n = confusion(scored, labels, "quality")
    assert n > 1000 and kept > 0.98 and wrong < 0.05


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op3_toxicity(spark, SF).cache()
    check_rows(scored, docs, 0.7)
    caught, wrong, n = confusion(scored, labels, "toxic")
    assert n > 1000 and caught > 0.75 and wrong < 0.03


def test_held_out_labels_are_not_learned(spark, docs_of):
    """Turning every held-out label round changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        one, two = ({r.doc_id: r.score for r in score(docs, l).collect()} for l in (labels, turned))
        assert one == two


def odd_docs(docs_of):
    good = [(i, f"Some plain words of text number {i} and a few more.") for i in range(1, 60)]
    bad = [(100 + i, f"BUY!! NOW!! NUMBER {i}!! idiot loser scum!!") for i in range(60)]
    return docs_of([*good, *bad, (500, None), (501, ""), (502, "word " * 300_000), (None, "no id"), (1, "again")]).withColumns({"score": F.lit(9), "y": F.lit("x"), "toxic": F.lit(1)})


def test_odd_rows(spark, docs_of):
    docs = odd_docs(docs_of)
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(1, 60)), *((100 + i, 0, 1) for i in range(60)), (1, 1, 0), (None, 1, 1), (5, None, None), (9999, 0, 1)], LABELS).withColumn("text", F.lit("z"))
    for score, threshold, column in ((quality.quality_scores, 0.5, 0), (toxicity.toxicity_scores, 0.7, 1)):
        for given in (labels, labels.limit(0), labels.where("quality = 1")):
            check_rows(score(docs, given), docs, threshold)
        assert score(docs.limit(0), labels).count() == 0
        by = {r.doc_id: r.predicted for r in score(docs, labels).collect()}
        assert all(by[i] == 1 - column for i in range(2, 60)) and all(by[100 + i] == column for i in range(60))
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(1, 60))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 0]) + 0.3 + rng.normal(size=80) * 0.5 > 0, 1.0, -1.0)
    cost = np.ones(80)
    w, b = quality.dual_coordinate_descent([np.arange(5)] * 80, lambda i: x[i], y, 5, cost, epochs=2000)
    value = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = value(w, b)
    for _ in range(300):
        assert value(w + rng.normal(size=5) * 0.01, b + rng.normal() * 0.01) >= best - 1e-3


def test_log_count_ratio():
    counts, docs = np.array([[1, 0, 8], [3, 1, 8]]), np.array([10, 10])
    got = quality.log_count_ratio(counts, docs)
    np.testing.assert_allclose(got, [np.log((4 / 12) / (2 / 12)), 0.0, 0.0])


def test_label_model_finds_rates(spark):
    """Independent voters with known rates, and a copy of one: rates are found, the copy shares its weight."""
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    on1, on0 = np.array([0.7, 0.5, 0.6, 0.4, 0.5]), np.array([0.05, 0.02, 0.1, 0.03, 0.05])
    votes = rng.random((6000, 5)) < np.where(y[:, None], on1, on0)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)
    label = np.where(rng.random(6000) < 0.1, y.astype(int), -1)
    rows = [(bytearray(np.packbits(v).tobytes()), None if l < 0 else int(l), 1) for v, l in zip(votes, label)]
    model = toxicity.fit_label_model(spark.createDataFrame(rows, "pattern binary, y int, n long"), 6)
    np.testing.assert_allclose(model.on1[:5], on1, atol=0.08)
    np.testing.assert_allclose(model.on0[:5], on0, atol=0.03)
    assert abs(model.prior - 0.2) < 0.05 and model.weight[0] < 0.6 and model.weight[1] > 0.9


def test_features_of_odd_texts():
    words, shapes = features.word_features(), features.shape_features()
    for text in ("", " \n", "...", "é", "A" * 100_000, "a b a b a b"):
        for f in (words(text), shapes(text)):
            assert f.dtype.kind == "i" and (np.diff(f) > 0).all() and (f >= 0).all() and (f < features.DIM).all()
