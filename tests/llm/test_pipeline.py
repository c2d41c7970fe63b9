"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .test_dedup import plain_fingerprint, simhash_classes
from .test_filters import brute_spans
from .test_texts import TIKTOKEN

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        out.append(docs)
        docs = P.common.shared_table(stage(spark, docs, SF), name)
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(results):
    assert len({tuple(d.columns) for d in results[:-1]}) == 1


def test_quality_keeps_labelled_good_documents(spark, results):
    before, after = rows(results[0]), rows(results[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in good) / len(good) > 0.97 and sum(d in after for d in bad) / len(bad) < 0.15
    assert all(before[d] == r for d, r in after.items())


def test_one_of_each_group_stays(results):
    before, after = rows(results[1]), rows(results[2])
    classes = simhash_classes([(d, plain_fingerprint(r.text)) for d, r in before.items()])
    assert set(after) == set(classes) and all(before[d] == r for d, r in after.items())


def test_passages_go(spark, results):
    before, after = rows(results[2]), rows(results[3])
    items = [P.decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, r in before.items() if any(i in P.decontam.normal(r.text) for i in items)}
    assert leaked and set(before) - set(after) == leaked


def test_secrets_are_replaced(results):
    before, after = rows(results[3]), rows(results[4])
    assert set(before) == set(after)
    for d, r in after.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(before[d].text).split(",") if s]
        stretches = []  # spans that overlap, as a token's value that is hex too, are one stretch
        for a, b in spans:
            if stretches and a < stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        want = before[d].text
        for a, b in reversed(stretches):
            want = want[:a] + "[SECRET]" + want[b:]
        assert r.text == want


def test_ids_of_what_is_left(results):
    texts, ids = rows(results[4]), rows(results[5])
    assert set(texts) == set(ids)
    for d, r in ids.items():
        want = np.array(TIKTOKEN.encode_ordinary(texts[d].text), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[d].text.encode()).hexdigest()


def test_run_is_the_stages(spark, results):
    assert sorted(P.run(spark, SF).collect()) == sorted(results[-1].collect())


def test_odd_documents_pass_every_stage(spark, docs_of, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    odd = [(1, None), (2, ""), (2, ""), (None, "text of a row that has no id"), (None, None), (3, "word " * 100_000), (4, "plain text that stays as it is"), (4, "plain text that stays as it is"), (5, "plain text that stays as it is")]
    for given in (docs_of(odd), docs_of([])):
        for _, stage in P.STAGES:
            out = stage(spark, given, str(tmp_path))
            assert out.count() <= given.count()
    kept = P.dedup_stage(spark, docs_of(odd), str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 1), (True, 3), (True, 4)]


def test_each_group_keeps_one_row_if_an_id_has_unlike_texts(spark, docs_of):
    words = [f"w{i * 7919 % 1009}" for i in range(1500)]
    base = plain_fingerprint(" ".join(words))
    changed = (" ".join([*words[:i], "other", *words[i + 1:]]) for i in range(len(words)))
    near = next(t for t in changed if 1 <= (plain_fingerprint(t) ^ base).bit_count() <= 2)
    a, b = "an unlike text that stands far away from it", "some words that are another document of the same id"
    assert (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 2
    given = [(5, a), (5, b), (7, b.upper()), (None, " ".join(words)), (None, near)]
    kept = [(r.doc_id, r.text) for r in P.dedup_stage(spark, docs_of(given), SF).collect()]
    assert sorted(t for i, t in kept if i is not None) == sorted([a, b]) and {i for i, _ in kept} == {5, None}
    assert len(kept) == 3


def test_stages_keep_columns_of_any_name_and_type(spark, docs_of):
    docs = docs_of([(1, "same text here"), (1, "same text here"), (2, "password: hunter2hunter2 and more")])
    docs = docs.withColumns({"_hash": F.lit("mine"), "spans": F.lit("ours"), "kept": F.create_map(F.lit("k"), F.col("doc_id"))})
    for stage in (P.dedup_stage, P.secret_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {(r.doc_id, r._hash, r.spans, r.kept["k"]) for r in out.collect()} == {(1, "mine", "ours", 1), (2, "mine", "ours", 2)}
    assert P.dedup_stage(spark, docs, SF).count() == 2
